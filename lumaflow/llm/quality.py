"""Quality rules: hashed n-gram log-likelihood ratio of a trusted and the raw multinomial (operator 1)."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, words

#: Fixed by the contract.
WINDOW, LEAST_WORDS, REPEAT_PERCENT, SYMBOLS = 8, 20, 30, "[#*$%&|<>]"
#: Hash buckets that words and word pairs share; the model is so many integers, however large the corpus.
BUCKETS = 1 << 14
#: Weights are log ratios times SCALE as whole numbers, so that sums don't depend on order; SMOOTH is added to each count.
SCALE, SMOOTH = 1000, 1.0
#: A document is kept if the mean weight of its words and pairs is at least this.
LEAST_MEAN = -100


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def word_buckets(w: Column) -> Column:
    """The bucket of each word: its CRC-32 modulo BUCKETS."""
    return F.transform(w, lambda x: F.crc32(x.cast("binary")).bitwiseAND(BUCKETS - 1).cast("short"))


def features(buckets: Column) -> Column:
    """Buckets of all words and of all pairs of neighbours; a pair's bucket follows from its words' buckets."""
    def of(n: Column) -> Column:
        most = F.greatest(F.size(n) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(n, F.lit(1), most), F.slice(n, F.lit(2), most), lambda a, b: (a.cast("int") * 31 + b.cast("int") * 17 + 7).bitwiseAND(BUCKETS - 1).cast("short"))
        return F.concat(n, pairs)
    return _let(buckets, of)


def _repeat_words(w: Column) -> Column:
    """Words in windows that occur twice or more in the text."""
    def places(win: Column) -> Column:
        def covered(at: Column) -> Column:
            steps = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)
        def alike(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
            return _let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)
        ordered = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(win)) < F.size(win), _let(ordered, alike)).otherwise(0)
    def doubled(h: Column, k: int) -> Column:
        n = F.size(h) - k
        return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(1 + k), n), lambda a, b: F.xxhash64(a, b))
    def of(half: Column) -> Column:
        # a window that occurs twice has a half that does
        return F.when(F.size(F.array_distinct(half)) < F.size(half), _let(doubled(half, WINDOW // 2), places)).otherwise(0)
    hashed = F.transform(w, lambda x: F.xxhash64(x))
    return F.when(F.size(w) > WINDOW, _let(_let(_let(hashed, lambda h: doubled(h, 1)), lambda h: doubled(h, 2)), of)).otherwise(0).cast("long")


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _w (words) and the contract's counts and base verdict. Null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("_w", words(F.col(text)))
    full = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != "")
    d = d.withColumn("n_words", F.size("_w").cast("long")).withColumn("word_chars", F.char_length(F.array_join("_w", "")).cast("long"))
    d = d.withColumn("n_symbols", (F.char_length(t) - F.char_length(F.regexp_replace(t, SYMBOLS + "+", ""))).cast("long"))
    d = d.withColumn("n_dup_lines", _let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    d = d.withColumn("n_repeat_words", _repeat_words(F.col("_w")))
    return d.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def fit(docs: DataFrame, trusted: DataFrame) -> list[int]:
    """Weights of the buckets: log(p_trusted / p_raw), times SCALE, rounded.

    The raw multinomial counts every document, the trusted one those whose doc_id is in ``trusted``. What is shuffled to
    meet the trusted ids is two bytes a word, not the texts; documents without an id stay where they are. Counts are
    summed by bucket before they are shuffled, so a hot word costs a row for each task. The result has BUCKETS entries.
    Without trusted words all weights are 0.
    """
    ids = trusted.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().withColumn("_trusted", F.lit(1))
    d = docs.select("doc_id", word_buckets(words(F.col("text"))).alias("_b"))
    marked = d.where("doc_id IS NOT NULL").join(ids.hint("merge"), "doc_id", "left").select(F.coalesce("_trusted", F.lit(0)).alias("t"), "_b")
    marked = marked.union(d.where("doc_id IS NULL").select(F.lit(0).alias("t"), "_b"))
    counts = marked.select("t", F.explode(features(F.col("_b"))).alias("b")).groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("trusted")).collect()
    raw, t = {r["b"]: r["raw"] for r in counts}, {r["b"]: r["trusted"] for r in counts}
    n_raw, n_t = sum(raw.values()), sum(t.values())
    if not n_t:
        return [0] * BUCKETS
    of = lambda x, n: math.log((x + SMOOTH) / (n + SMOOTH * BUCKETS))
    return [round(SCALE * (of(t.get(b, 0), n_t) - of(raw.get(b, 0), n_raw))) for b in range(BUCKETS)]


def judge(docs: DataFrame, weights: list[int]) -> DataFrame:
    """Adds the base columns, score (sum of weights), n_features and kept.

    Every document is judged by itself, whatever its doc_id; repeated rows are judged alike, a null or empty text has
    no words and fails the base rules. Other columns have no effect.
    """
    table = F.from_json(F.lit(json.dumps(weights)), "array<int>")
    d = with_base(docs)
    d = d.withColumn("_f", features(word_buckets(F.col("_w")))).withColumn("n_features", F.size("_f").cast("long"))
    d = d.withColumn("score", F.aggregate("_f", F.lit(0).cast("long"), lambda a, b: a + F.get(table, b)))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= LEAST_MEAN * F.col("n_features"))).drop("_w", "_f")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return judge(docs, fit(docs, trusted)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", "n_features")


OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
u AS (SELECT r, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS crc),
x AS (SELECT word, hex(encode(word)) AS hx FROM (SELECT DISTINCT word FROM u)),
y AS (SELECT word, list_transform(range(len(hx) // 2), lambda i: CAST('0x' || substr(hx, 2 * i + 1, 2) AS BIGINT)) AS bytes FROM x),
z AS (SELECT word, xor(4294967295, list_reduce(bytes, lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295)) AS h FROM y, tab),
n AS (SELECT u.*, z.h FROM u JOIN z USING (word)),
f AS (SELECT r, doc_id, h % {BUCKETS} AS b FROM n
      UNION ALL
      SELECT r, doc_id, (h * 31 + k * 17 + 7) % {BUCKETS} FROM (SELECT r, doc_id, h, lead(h) OVER (PARTITION BY r ORDER BY i) AS k FROM n) WHERE k IS NOT NULL),
c AS (SELECT b, count(*) AS raw, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS t FROM f GROUP BY b),
s AS (SELECT sum(raw) AS raw, sum(t) AS t FROM c),
m AS (SELECT c.b, CASE WHEN s.t = 0 THEN 0 ELSE CAST(round_even({SCALE} * (ln((c.t + 1.0) / (s.t + {BUCKETS}.0)) - ln((c.raw + 1.0) / (s.raw + {BUCKETS}.0))), 0) AS BIGINT) END AS v FROM c, s),
score AS (SELECT r, sum(v) AS score, count(*) AS n FROM f JOIN m USING (b) GROUP BY r),
win AS (SELECT r, i, array_to_string(list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING), ' ') AS x,
               count(*) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS k FROM u),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM win WHERE k = 8) WHERE c > 1),
cov AS (SELECT r, sum(least(8, coalesce(nx - i, 8))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM rep) GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY r),
o AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(score.score, 0) AS BIGINT) AS score, CAST(coalesce(score.n, 0) AS BIGINT) AS n_features
      FROM d LEFT JOIN l USING (r) LEFT JOIN cov USING (r) LEFT JOIN score USING (r)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND score >= {LEAST_MEAN} * n_features AS kept, score, n_features FROM b
"""
