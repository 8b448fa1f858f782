"""Operator 9's notices against edit distances, rivals that share words, and texts full of seeds."""

import random
import time

import pytest

from lumaflow.llm import licenses

SCAN = licenses.Scanner()


def folded(text):
    return licenses.fold(text).decode()


def distance(pattern, text):
    """The least edits between the pattern and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_near():
    rng = random.Random(1)
    for _ in range(600):
        p, t = ("".join(rng.choice("ab c") for _ in range(rng.randrange(1, 12))) for _ in range(2))
        for k in range(4):
            assert licenses.near(licenses.letters(p), len(p), t, k) == (distance(p, t) <= k) or distance(p, "") <= k


def edited(notice, telling, n, rng):
    """The notice with n edits that touch no telling word."""
    words, kept = notice.split(), telling.split()
    spots, at = [], 0
    for w in words:
        if kept and w == kept[0]:
            kept.pop(0)
        else:
            spots += [*range(at, at + len(w))]
        at += len(w) + 1
    text = list(notice)
    for k in sorted(rng.sample(spots, n), reverse=True):
        kind = rng.randrange(3)
        text[k : k + 1] = [] if kind == 0 else ["q"] if kind == 1 else [text[k], "z"]
    return "".join(text)


def test_notices_with_edits_are_found():
    """Each notice, with up to its bound of edits outside the telling words, gives its label; what is told is a true distance."""
    rng = random.Random(8)
    for notice, (label, telling) in licenses.NOTICES.items():
        bound = max(1, len(notice) // licenses.SPAN)
        free = sum(map(len, notice.split())) - sum(map(len, telling.split()))
        for n in range(bound + 1):
            if n > free // 4:
                continue
            text = folded(f"once upon a time {edited(notice, telling, n, rng)} and they lived")
            hits = [h for h in SCAN.all(text) if h[0] == label]
            assert hits, (notice, text)
            # the window of the first seed may cut the best stretch: what is told then has more edits, but never more than the bound
            assert distance(notice, text) <= min(h[3] for h in hits if h[2] - h[1] + h[3] >= len(notice)) <= bound


def test_distances_on_random_texts():
    """Random mixtures of a notice's words: a hit always is within the bound by dynamic programming."""
    rng = random.Random(3)
    names = ["licensed under the mit license", "creative commons attribution", "dedicated to the public domain"]
    scan = licenses.Scanner({n: licenses.NOTICES[n] for n in names})
    words = [w for n in names for w in n.split()] + ["x", "licence", "thee", "domainn"]
    found = 0
    for _ in range(400):
        text = folded(" ".join(rng.choice(words) if rng.random() < 0.4 else rng.choice(names) for _ in range(5)))
        hits = scan.all(text)
        for n in names:
            d = distance(n, text)
            mine = [h for h in hits if h[0] == licenses.NOTICES[n][0]]
            assert not mine or d <= max(1, len(n) // licenses.SPAN)
            if f" {n} " in text:
                assert any(h[3] == 0 for h in mine)
            found += bool(mine)
    assert found > 100


@pytest.mark.parametrize("text, labels", [
    ("Creative Commons Attribution-NonCommercial", "cc-by-nc"), ("licensed under a Creative Commons Attribution-NonCommercial license", "cc-by-nc"), ("attribution sharealike creative commons attribution sharealike 4.0", "cc-by-sa"),
    ("Creative Commons Attribution Non-Commercial No-Derivatives", "cc-by-nc-nd"), ("Licensed under the Creative Commons Attribution Share Alike", "cc-by-sa"), ("Creative Commons Attribution 4.0 International", "cc-by"),
    ("under the terms of the GNU Affero General Public License", "agpl,gpl"), ("SPDX-License-Identifier: ISC", "isc"), ("SPDX-License-Identifier: MPL-2.0", "mpl"), ("Licensed under the MIT license", "mit"), ("Apachee License", ""),
    ("Creative Commons Attribution. And elsewhere: Creative Commons Attribution NonCommercial", "cc-by,cc-by-nc"),
])
def test_the_longest_notice_wins(spark, text, labels):
    r = licenses.scan(spark.createDataFrame([(1, f"It is {text}; so.")], "doc_id long, text string"), ["doc_id"]).first()
    assert r["labels"] == labels


@pytest.mark.parametrize("unit", ["under the terms of the gnu ", "licensed under the mit license ", "permission is hereby granted free of charg ", "creative commons attribution "])
def test_dense_seeds(unit):
    text = folded(unit * (300_000 // len(unit)))
    began = time.perf_counter()
    SCAN(text)
    assert time.perf_counter() - began < 20
