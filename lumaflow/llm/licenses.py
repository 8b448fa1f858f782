"""Licence scans: fuzzy search for short notices (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small_batches, texts_of

#: Fixed by the contract: exact phrases and their labels.
BASE = {b"cc by": "cc-by", b"general public license": "gpl", b"all rights reserved": "reserved"}
#: Short notices (folded: lower case, words parted by a space), the labels they give, and the words that tell a notice
#: from those of other licences: these must stand in the text unedited, in this order.
NOTICES = {
    "licensed under the apache license version 2 0": ("apache-2.0", "apache version 2 0"),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", "permission granted"),
    "released under the terms of the mit license": ("mit", "mit"),
    "licensed under the mit license": ("mit", "mit"),
    "permission to use copy modify and or distribute this software for any purpose": ("isc", "permission distribute"),
    "this software is provided as is without any express or implied warranty": ("zlib", "software provided without"),
    "this is free and unencumbered software released into the public domain": ("unlicense", "unencumbered public domain"),
    "redistribution and use in source and binary forms": ("bsd", "source binary"),
    "subject to the terms of the mozilla public license": ("mpl", "mozilla"),
    "under the terms of the eclipse public license": ("epl", "eclipse"),
    "dedicated to the public domain": ("public-domain", "public domain"),
    "no part of this publication may be reproduced": ("reserved", "no part"),
    "unauthorized copying of this file is strictly prohibited": ("proprietary", "unauthorized prohibited"),
}
# families: the name of a licence decides, so it is part of the notice, and of its telling words
for _kind, _label in {"general": "gpl", "lesser general": "lgpl", "affero general": "agpl"}.items():
    for _start in ("this work is licensed under the gnu", "under the terms of the gnu"):
        NOTICES[f"{_start} {_kind} public license"] = (_label, f"gnu {_kind}")
_SPELT = {"nc": ("noncommercial", "non commercial"), "sa": ("sharealike", "share alike"), "nd": ("noderivatives", "no derivatives")}
for _terms in ((), ("nc",), ("sa",), ("nd",), ("nc", "sa"), ("nc", "nd")):
    for _words in product(*(_SPELT[t] for t in _terms)):
        _name = " ".join(("creative commons attribution", *_words))
        for _start in ("", "licensed under a ", "licensed under the "):
            NOTICES[_start + _name] = ("-".join(("cc-by", *_terms)), _name)
NOTICES["this work is licensed under cc by"] = ("cc-by", "cc by")
for _id, _label in {"mit": "mit", "isc": "isc", "zlib": "zlib", "unlicense": "unlicense", "apache 2 0": "apache-2.0", "mpl 2 0": "mpl", "epl 2 0": "epl", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "gpl 2 0": "gpl", "gpl 3 0": "gpl", "lgpl 2 1": "lgpl", "lgpl 3 0": "lgpl", "agpl 3 0": "agpl"}.items():
    NOTICES[f"spdx license identifier {_id}"] = (_label, f"spdx identifier {_id}")
#: A notice of n characters may have n // SPAN edits (insertions, deletions, substitutions), one at least.
SPAN = 12
_WORD = bytes(c if c >= 128 or chr(c).isdigit() or "a" <= chr(c) <= "z" else c + 32 if "A" <= chr(c) <= "Z" else 32 for c in range(256))


def fold(text: str) -> bytes:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, each with a space on both sides."""
    return b" " + b" ".join(text.encode("utf-8", "surrogatepass").translate(_WORD).split()) + b" "


def letters(pattern: str) -> dict[str, int]:
    """For each character the places, as bits, at which it stands in the pattern."""
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def near(places: dict[str, int], size: int, text: str, most: int) -> bool:
    """Whether a stretch of the text has at most so many edits from the pattern: a column of the distance table at a time,
    its steps held as the bits of two numbers (Myers 1999). Tells cheaply where a search with errors finds nothing."""
    full, top = (1 << size) - 1, 1 << size - 1
    up, down, d = full, 0, size
    for c in text:
        eq = places.get(c, 0)
        x = ((eq & up) + up ^ up) | eq
        rise, fall = down | ~(x | up) & full, up & x
        d += bool(rise & top) - bool(fall & top)
        if d <= most:
            return True
        rise, fall, v = rise << 1 & full, fall << 1 & full, eq | down
        up, down = fall | ~(v | rise) & full, rise & v
    return False


class Scanner:
    """Exact seeds by Aho-Corasick, then bounded-error matching around them.

    A notice with at most k edits keeps one of its k + 1 pieces unchanged (pigeonhole), so a text without any piece
    of a notice can't hold it; only the surroundings of a piece are matched with errors, and those only if a notice's
    telling words stand there.
    """

    def __init__(self, notices: dict[str, tuple[str, str]] = NOTICES, span: int = SPAN):
        import ahocorasick
        import regex

        self.notices, self.letters, seeds = [], [], {}
        for text, (label, telling) in notices.items():
            k = max(1, len(text) // span)
            cuts = [round(i * len(text) / (k + 1)) for i in range(k + 2)]
            n = len(self.notices)
            self.notices.append((text, label, telling.split(), k, regex.compile(f"(?b)(?:{regex.escape(text)}){{e<={k}}}")))
            self.letters.append(letters(text))
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(text[a:b], []).append((n, a))
        self.seeds = ahocorasick.Automaton()
        for s, of in seeds.items():
            self.seeds.add_word(s, (len(s), of))
        self.seeds.make_automaton()

    def all(self, folded: str) -> list[tuple[str, int, int, int, float]]:
        """(label, start, end, edits, likeness) of every notice found; a place counts once for each notice.

        Edits may touch all words but a notice's telling ones: those stand whole and in order in the words of the match.
        """
        found, done, tried, size = [], {}, {}, len(folded)
        for end, (length, of) in self.seeds.iter(folded):
            for n, at in of:
                text, label, telling, k, pattern = self.notices[n]
                start = end - length + 1 - at
                if start < done.get(n, -1) or tried.get(n) == start:
                    continue
                tried[n] = start
                if start >= 0 and folded.startswith(text, start) and folded[start - 1 : start] == " " == folded[start + len(text) : start + len(text) + 1]:
                    done[n] = start + len(text)
                    found.append((label, start, done[n], 0, 1.0))
                    continue
                low, high = max(0, start - k), min(size, start + len(text) + k)
                if not self._told(telling, folded, low, high) or not near(self.letters[n], len(text), folded[low:high], k):
                    continue
                if (m := pattern.search(folded, low, high)) and self._told(telling, folded, m.start(), m.end()):
                    done[n] = m.end()
                    edits = sum(m.fuzzy_counts)
                    found.append((label, m.start(), m.end(), edits, 1 - edits / len(text)))
        return found

    @staticmethod
    def _told(telling: list[str], folded: str, low: int, high: int) -> bool:
        """Whether the words that this stretch touches hold the telling ones in order."""
        near = folded[max(0, folded.rfind(" ", 0, low + 1)) : high + len(folded[high - 1 : high + 40].partition(" ")[0])] + " "
        at = 0
        for w in telling:
            if (at := near.find(f" {w} ", at)) < 0:
                return False
            at += 1 + len(w)
        return True

    def __call__(self, folded: str) -> list[tuple[str, int, int, int, float]]:
        """Of ``all``, where notices with different labels share characters, the longest one, then the one with fewest edits: a licence named in full is not also one whose name is part of its own."""
        out: list[tuple[str, int, int, int, float]] = []
        group: list[tuple[str, int, int, int, float]] = []
        reach = -1
        for hit in sorted(self.all(folded), key=lambda h: (h[1], h[2])):
            if hit[1] + 1 >= reach:
                out += _longest(group)
                group = []
            group.append(hit)
            reach = max(reach, hit[2])
        return out + _longest(group)


def _longest(hits: list[tuple[str, int, int, int, float]]) -> list[tuple[str, int, int, int, float]]:
    """Hits in the order of their places, without those that share more than a space with a longer one of another label."""
    kept: list[tuple[str, int, int, int, float]] = []
    for h in sorted(hits, key=lambda h: (h[1] - h[2], h[3], h[1])):
        if all(h[0] == x[0] or min(h[2], x[2]) - max(h[1], x[1]) <= 1 for x in kept):
            kept.append(h)
    return sorted(kept, key=lambda h: (h[1], h[2]))


def word_numbers(text: str, places: list[int]) -> list[int]:
    """The number, from 0, of the word at each place of a folded text (a space belongs to the word after it)."""
    spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
    return (np.searchsorted(spaces, np.asarray(places, np.int64), side="right") - 1).tolist()


def base_places(folded: bytes, phrase: bytes) -> list[int]:
    """Numbers of the words at which the phrase starts; each byte is looked at twice at most."""
    out, word, seen, at = [], 0, 0, folded.find(b" " + phrase + b" ")
    while at >= 0:
        word += folded.count(b" ", seen, at)
        out.append(word)
        seen, at = at, folded.find(b" " + phrase + b" ", at + 1)
    return out


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns with n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    Words count from 0; spans are (label, first word, last word, edits). Null and empty texts: no words, no labels,
    score 0. Each row stands for itself: repeated rows give equal results, other columns have no effect.
    """
    src = docs.select(*keep, F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())])
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for t in texts_of(b.column(b.num_columns - 1)):
                folded = fold(t)
                n_words = folded.count(b" ") - 1 if len(folded) > 2 else 0
                starts, base = [], set()
                for phrase, label in BASE.items():
                    if at := base_places(folded, phrase):
                        starts += at
                        base.add(label)
                text = folded.decode("utf-8", "surrogatepass")
                hits = scanner(text)
                ends = word_numbers(text, [p for _, a, e, *_ in hits for p in (a, a + len(text[a:e].rstrip()) - 1)]) if hits else []
                spans = [{"label": h[0], "first_word": i, "last_word": j, "edits": h[3]} for h, i, j in zip(hits, ends[::2], ends[1::2])]
                every = base | {h[0] for h in hits}
                values = (n_words, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(every)), 1.0 if base else max((h[4] for h in hits), default=0.0), spans)
                for column, v in zip(out, values):
                    column.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(x, k) for x, k in zip(out, kinds))], names=[*b.schema.names[:-1], "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{fields}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,edits:int>>")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return scan(documents(spark, sf_dir), ["doc_id"]).drop("spans")
