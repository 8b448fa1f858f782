"""Closed-set questions: the nearest of a catalog's values, or no answer."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import sigmoid, unit

#: Least margin of the first over the second, slope of the confidence, least score of a question, and of any other.
MARGIN, SLOPE = 0.01, 10.0
SCORES = {"time_of_day": 0.05, "action": 0.10, "object": 0.10, "shot_size": 0.08, "visual_effect": 0.10, "mood": 0.08}
SCORE = 0.10
#: Most questions of a catalog, and least and most values of a question.
QUESTIONS, VALUES = 8, (2, 12)


def least_score(question: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SCORES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, question), F.lit(SCORE))


def rows_of(catalog: DataFrame) -> list[tuple[str, str, list[float]]]:
    """The catalog (question, value, v) as (question, value, unit vector). A catalog is a request's; its size is checked when the plan is built."""
    most = QUESTIONS * VALUES[1]
    rows = [tuple(r) for r in catalog.select("question", "value", unit(F.col("v"))).limit(most + 1).collect()]
    per = Counter(q for q, *_ in rows)
    if len(rows) > most or len(per) > QUESTIONS or any(not VALUES[0] <= n <= VALUES[1] for n in per.values()):
        raise ValueError(f"a catalog has at most {QUESTIONS} questions of {VALUES[0]} to {VALUES[1]} values")
    return rows


def likeness(v: Column, to: np.ndarray) -> Column:
    """Cosines of a vector with each row of ``to``, whose rows have length 1, as one array: a matrix product a batch. Null vectors, and those of another size, have none; a zero vector is an error."""
    size = to.shape[1]

    @F.arrow_udf("array<double>")
    def of(batch: pa.Array) -> pa.Array:
        fits = pc.fill_null(pc.equal(pc.list_value_length(batch), size), False)
        x = pc.list_flatten(batch.filter(fits)).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
        length = np.sqrt((x * x).sum(axis=1, keepdims=True))
        if (length == 0).any():
            raise ValueError("zero vector")
        found = iter(((x / length) @ to.T).tolist())
        return pa.array([next(found) if f else None for f in fits.to_pylist()], pa.list_(pa.float64()))

    return of(v)


def answers(frames: DataFrame, catalog: DataFrame, score: float | None = None, margin: float = MARGIN) -> DataFrame:
    """(item_id, question, answer, status, margin, confidence, top value and score).

    ``frames`` is (item_id, v). A value's score for an item is its best over the item's frames; the answer is null where
    the score is below the question's least (or ``score``, if given) or the margin is too low. Each frame is multiplied
    with the whole catalog at once; frames of an item meet in one shuffle, each task's best of them first.
    """
    rows = rows_of(catalog)
    if not rows:
        return frames.select("item_id", *[F.lit(None).cast(k).alias(c) for c, k in {"question": "string", "answer": "string", "status": "string", "margin": "double", "confidence": "double", "top_value": "string", "top_score": "double"}.items()]).limit(0)
    s = frames.select("item_id", likeness(F.col("v"), np.array([v for *_, v in rows])).alias("s"))
    s = s.groupBy("item_id").agg(*[F.max(F.get("s", F.lit(k))).alias(f"_{k}") for k in range(len(rows))])
    ranked = []
    for question in dict.fromkeys(q for q, *_ in rows):
        own = [F.struct((-F.col(f"_{k}")).alias("less"), F.lit(value).alias("value")) for k, (q, value, _) in enumerate(rows) if q == question]
        ranked.append(F.struct(F.lit(question).alias("question"), F.slice(F.sort_array(F.array(*own)), 1, 2).alias("top")))
    r = s.select("item_id", F.explode(F.array(*ranked)).alias("x")).select("item_id", "x.question", F.col("x.top")[0]["value"].alias("value"), (-F.col("x.top")[0]["less"]).alias("score"), (F.col("x.top")[1]["less"] - F.col("x.top")[0]["less"]).alias("gap"))
    gap = F.col("gap")
    ok = (F.col("score") >= (least_score(F.col("question")) if score is None else F.lit(score))) & (gap >= margin)
    return r.select("item_id", "question", F.when(ok, F.col("value")).alias("answer"), F.when(ok, "answered").otherwise("abstained").alias("status"), F.round(gap, 6).alias("margin"), F.round(sigmoid(SLOPE * gap), 6).alias("confidence"), F.col("value").alias("top_value"), F.round("score", 6).alias("top_score"))
