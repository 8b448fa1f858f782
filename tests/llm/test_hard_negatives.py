"""Operator 11 against a plain version: nulls, ties, repeated rows, odd vectors, small blocks."""

import math
import random

import numpy as np
import pytest

from lumaflow.llm import hard_negatives

DDL = "vec_id long, embedding array<float>, label int, score long, id long, rows string, block string"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows, every=100, positives=5, negatives=5, percent=80):
    """All of it by loops over whole numbers; rows are (id, vector, label)."""
    part = [(i, [math.floor(256 * float(np.float32(x))) for x in v], l) for i, v, l in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda x: (-x[1], x[0] is None, x[0] or 0)
    out = []
    for k, (i, v, l) in enumerate(part):
        if i is None or i % every:
            continue
        scored = [(j, sum(a * b for a, b in zip(v, w)), m) for n, (j, w, m) in enumerate(part) if n != k]
        for j, p, _ in sorted((x for x in scored if x[2] == l), key=order)[:positives]:
            fit = sorted((x for x in scored if x[2] != l and percent * p <= 100 * x[1] <= 100 * p), key=order)[:negatives]
            out += [(i, j, n, x[0], p, x[1]) for n, x in enumerate(fit, 1)]
    return sorted(out, key=str)


def run(spark, rows, parts=3, **more):
    df = spark.createDataFrame([(*r, 1, 2, "r", "b") for r in rows], DDL).repartition(parts)
    got = hard_negatives.mine(df, **more)
    assert got.columns == NAMES
    return sorted(map(tuple, got.collect()), key=str)


def random_rows(n, dim, labels, seed, scale=1.0):
    rng = random.Random(seed)
    return [(i, [round(rng.gauss(0.1, 0.3) * scale, 2) for _ in range(dim)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("n, dim, labels, every", [(300, 8, 3, 10), (250, 1, 2, 25), (200, 3, 40, 7), (60, 4, 1, 5)])
def test_random_tables(spark, n, dim, labels, every):
    rows = random_rows(n, dim, labels, n)
    assert run(spark, rows, every=every) == plain(rows, every=every)


def test_small_blocks(spark, monkeypatch):
    """Blocks of a few rows, several blocks of anchors: the same rows, which come in runs."""
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    monkeypatch.setattr(hard_negatives, "AT_ONCE", 3)
    rows = random_rows(400, 2, 4, 5)
    assert run(spark, rows, parts=40, every=10) == plain(rows, every=10)


def test_nulls_ties_and_repeats(spark):
    v = [0.5, 0.25]
    rows = [(0, v, 1), (0, v, 1), (100, v, 2), (None, v, 1), (None, v, 3), (7, v, 1), (7, v, 2), (8, None, 1), (9, v, None), (10, [0.5, None], 1), (11, [float("nan"), 0.1], 2), (12, [float("inf"), 0.1], 2), (13, [], 1), (14, [0.5], 3), (15, [-0.5, -0.25], 1), (200, [0.0, 0.0], 1), (16, [0.0, 0.0], 9)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, positives=1, negatives=1, percent=0) == plain(rows, positives=1, negatives=1, percent=0)


def test_many_copies(spark):
    """A third of the rows is one vector, its label one label."""
    rows = [(i, [0.5, 0.5, 0.1], 1) for i in range(200)] + [(i, v, l) for i, v, l in ((i + 200, v, l) for i, v, l in random_rows(300, 3, 5, 3))]
    assert run(spark, rows, every=20) == plain(rows, every=20)


def test_large_components(spark):
    """Beyond two bytes, beyond exact doubles, and beyond a long, where scores become its limit."""
    rows = random_rows(80, 4, 3, 11, scale=1e5)
    assert run(spark, rows, every=10) == plain(rows, every=10)
    rows = random_rows(60, 4, 3, 12, scale=1e6) + [(100, [3e7] * 4, 0), (101, [2e7, 1.0, -2e7, 5.0], 1)]
    assert run(spark, rows, every=20) == plain(rows, every=20)
    rows = [(0, [1e30], 0), (1, [1e30], 0), (2, [1e30], 1), (3, [0.0], 1)]
    most = 2**63 - 1
    assert run(spark, rows) == [(0, 1, 1, 2, most, most)]


def test_no_rows(spark):
    assert run(spark, []) == [] and run(spark, [(1, [0.5], 1)]) == [] and run(spark, [(0, None, None)]) == []


def test_sorted_runs():
    """A positive's range is read from the whole sorted run: nothing above it, nothing below its share, ids in order."""
    ids, labels = np.arange(6), np.array([0, 1, 1, 0, 1, 1])
    q, a = np.array([[10], [10], [8], [9], [7], [8]]), np.array([[10]])
    got = list(hard_negatives.first_unlike(ids, labels, q, np.array([0]), a, [[100, 90]], 80, 5))
    assert got == [(0, 0, 1, 100), (0, 0, 2, 80), (0, 0, 5, 80), (0, 1, 2, 80), (0, 1, 5, 80)]
