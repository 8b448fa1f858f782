"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text (operator 10)."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, small_batches, texts_of

#: Look-alikes of Latin letters and digits or signs written for letters; each folds to one letter.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһгтмквнαοερτυικνхΑΒΕΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhrtmkbhaoeptuiknxabehikmnoptyx"))
DIGITS = dict(zip("0134578@$", "oieastbas"))
#: Words that weigh from the start, before any label is seen.
BASE_WORDS = ("idiot", "stupid", "trash", "scum", "moron", "loser", "worthless", "disgusting", "clown", "pathetic")
BASE_WEIGHT = 4.0
#: In these phrases (folded) a lexicon word is meant well, and doesn't count.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown", "sore loser board", "disgusting noise makers")
#: The classifier is fitted on the documents of at most so many labelled doc_ids, those least by a hash; one text each.
SAMPLE = 20_000
#: A feature needs this G-squared, this log-odds weight and so many toxic documents to enter the lexicon.
LEAST_G2, LEAST_WEIGHT, LEAST_TOXIC = 25.0, 2.0, 3
#: Features that a task counts before it passes its counts on.
COUNTED = 100_000
PREFIX_LENGTHS = range(4, 10)
THRESHOLD = 0.3
#: Where no label says more: intercept and coefficients of log(1 + hits' weight) and log(1 + weight per 1000 words).
START, RIDGE = (-4.0, 1.5, 0.5), 1.0


def _table() -> dict[int, str]:
    table = {c: " " for c in range(128) if not chr(c).isalnum()}
    # combining marks, soft hyphens and zero-width signs fall away
    table |= dict.fromkeys([0xAD, 0x34F, 0xFEFF, *range(0x300, 0x370), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0xFE00, 0xFE10)], "")
    return table | {ord(k): v for k, v in HOMOGLYPHS.items()} | {ord(k): v for k, v in DIGITS.items()}


_FOLD = _table()


def fold(text: str) -> str:
    """Lower case, compatibility forms, look-alikes and digit substitutions as letters, marks and zero-width signs gone,
    other ASCII signs as blanks; words parted by one space."""
    return " ".join((text if text.isascii() else unicodedata.normalize("NFKD", text)).lower().translate(_FOLD).split())


@dataclass
class Lexicon:
    """Weights of word starts; a start that ends in a space is a whole word."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: tuple[float, float, float] = START
    _machine: object = field(default=None, repr=False)

    def machine(self):
        import ahocorasick

        if self._machine is None:
            m = ahocorasick.Automaton()
            for k, w in self.weights.items():
                m.add_word(" " + k, (len(k) + 1, w))
            for k in self.exceptions:
                m.add_word(f" {k} ", (len(k) + 2, None))
            m.make_automaton()
            self._machine = m
        return self._machine

    def __getstate__(self):
        return self.__dict__ | {"_machine": None}

    def evidence(self, text: str) -> tuple[float, int, int]:
        """Sum of the hits' weights, hits and words. Each word counts once, by the heaviest entry that it starts with, unless it stands in an exception phrase."""
        folded = fold(text)
        at: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, w) in self.machine().iter(f" {folded} "):
            if w is None:
                spared.append((end - n + 1, end))
            else:
                at[end - n + 1] = max(w, at.get(end - n + 1, w))
        if spared:
            within = {k for a, b in spared for k in range(a, b)}
            at = {k: w for k, w in at.items() if k not in within}
        return sum(at.values()), len(at), folded.count(" ") + bool(folded)

    def score(self, weight: float, n_words: int) -> float:
        a, b, c = self.coefficients
        z = a + b * math.log1p(max(0.0, weight)) + c * math.log1p(1000 * max(0.0, weight) / max(n_words, 20))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and word starts with the toxic and clean documents that they are in; counts are passed on in parts."""
    toxic, clean = Counter(), Counter()

    def counts() -> pa.RecordBatch:
        names = [*toxic, *(k for k in clean if k not in toxic)]
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[k] for k in names], pa.int64()), pa.array([clean[k] for k in names], pa.int64())], names=["feature", "toxic", "clean"])
        toxic.clear(), clean.clear()
        return out

    for b in batches:
        for t, label in zip(texts_of(b.column(0)), b.column(1).to_pylist()):
            seen = {*fold(t).split()}
            (toxic if label else clean).update({w[:n] for w in seen for n in PREFIX_LENGTHS if len(w) >= n} | {w + " " for w in seen})
            if len(toxic) + len(clean) > COUNTED:
                yield counts()
    yield counts()


def _g2(a: Column, b: Column, ta: float, tb: float) -> Column:
    """G-squared of a of ta toxic and b of tb clean documents."""
    p = (a + b) / (ta + tb)
    part = lambda x, n, q: F.when((x > 0) & (n * q > 0), x * F.log(x / (n * q))).otherwise(0.0)
    return 2 * (part(a, ta, p) + part(b, tb, p) + part(ta - a, ta, 1 - p) + part(tb - b, tb, 1 - p))


def train(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Learns the lexicon and its scale from labelled rows that aren't held out.

    Documents in which a word start occurs are counted by label; what leans to toxic clearly (by G-squared) and
    strongly (by log-odds) enters with its log-odds as weight, shorter starts before longer ones that add nothing. The
    sample has at most SAMPLE documents, one text (the least) for each labelled doc_id; its features and the fitted rows
    are bounded by that. No label, or no toxic one: the base words and their start scale.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    known = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(SAMPLE)
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_toxic").cast("int").alias("label"))
    sample = cut(sample.select("text", "label"))
    totals = {r["label"] > 0: r["count"] for r in sample.groupBy(F.least("label", F.lit(1)).alias("label")).count().collect()}
    bad, good = totals.get(True, 0), totals.get(False, 0)
    weights = {k: BASE_WEIGHT for k in BASE_WORDS}
    if not bad or not good:
        return Lexicon({k + " ": w for k, w in weights.items()})
    counted = sample.mapInArrow(_features, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    weight = F.log((F.col("toxic") + 0.5) / (bad + 1.0)) - F.log((F.col("clean") + 0.5) / (good + 1.0))
    g2 = _g2(F.col("toxic").cast("double"), F.col("clean").cast("double"), float(bad), float(good))
    rows = counted.where((F.col("toxic") >= LEAST_TOXIC) & (weight >= LEAST_WEIGHT) & (g2 >= LEAST_G2)).select("feature", "toxic", weight.alias("weight")).collect()
    strong = {r["feature"]: r["weight"] for r in sorted(rows, key=lambda r: r["feature"])}
    # of word starts in the same toxic documents the longest says most
    n_toxic = {r["feature"]: r["toxic"] for r in rows}
    for k in sorted(strong, key=len, reverse=True):
        for n in range(min(PREFIX_LENGTHS), len(k)):
            if k in strong and n_toxic.get(k[:n]) == n_toxic[k]:
                strong.pop(k[:n], None)
    chosen: dict[str, float] = {}
    for k in sorted(strong, key=lambda k: (len(k), k)):
        if all(chosen.get(k[:n], 0.0) < strong[k] - 0.5 for n in range(min(PREFIX_LENGTHS), len(k))):
            chosen[k] = strong[k]
    lexicon = Lexicon({k + " ": w for k, w in weights.items()} | chosen)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [lexicon.evidence(t) for t in texts_of(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.int64()), b.column(1)], names=["weight", "words", "label"])

    xy = sample.mapInArrow(seen, "weight double, words long, label int").toPandas()
    w, n, y = xy["weight"].to_numpy(float), xy["words"].to_numpy(float), (xy["label"].to_numpy() > 0).astype(float)
    x = np.column_stack([np.ones_like(w), np.log1p(w), np.log1p(1000 * w / np.maximum(n, 20))])
    start, beta = np.array(START), np.array(START)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(3), x.T @ (y - p) - RIDGE * (beta - start))
        beta = beta + np.clip(step, -1, 1)
    lexicon.coefficients = tuple(map(float, beta))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """The kept columns, with _score, _predicted, _hits and _words. Null and empty texts have no hits. Each row stands for
    itself: repeated rows score alike, other columns have no effect. Only texts go to Python, and only numbers come back."""

    @F.arrow_udf("struct<score:double,hits:long,words:long>")
    def judged(text: pa.Array) -> pa.Array:
        found = [lexicon.evidence(t) for t in texts_of(text)]
        return pa.StructArray.from_arrays([pa.array([lexicon.score(w, n) for w, _, n in found], pa.float64()), pa.array([h for _, h, _ in found], pa.int64()), pa.array([n for *_, n in found], pa.int64())], names=["score", "hits", "words"])

    d = docs.select(*keep, judged("text").alias("_of"))
    return d.select(*keep, F.col("_of.score").alias("_score"), (F.col("_of.score") >= THRESHOLD).cast("int").alias("_predicted"), F.col("_of.hits").alias("_hits"), F.col("_of.words").alias("_words"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that a lexicon learned from the labels doesn't reject, with the columns of ``docs``. Documents with a
    null or empty text stay; of repeated rows all stay or none; no documents: none."""
    return score(docs, train(docs, labels), docs.columns).where("_predicted = 0").select(*docs.columns)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = documents(spark, sf_dir)
    lexicon = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, lexicon, ["doc_id"]).select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"), F.col("_hits").alias("n_hits"))
