"""Signatures against a hash at a time, and the time they take beside it."""

import time

import numpy as np
import pytest

from lumaflow.llm.fingerprints import BLOCK, MinHasher


def plain(m, shingles):
    out = [min(int(x) * int(a) + int(b) & (1 << 64) - 1 for x in shingles) >> 32 if len(shingles) else (1 << 32) - 1 for a, b in zip(m.a, m.b)]
    return np.array(out, np.uint32)


@pytest.mark.parametrize("n", [0, 1, BLOCK - 1, BLOCK, BLOCK + 1, 3 * BLOCK + 7])
def test_signature_of_any_length(n):
    m, x = MinHasher(), np.random.default_rng(n).integers(0, 1 << 64, n, np.uint64)
    assert (m.of(x) == plain(m, x)).all()


def test_all_permutations_at_once():
    """A pass for each permutation took most of the time of near_duplicate_documents' first step (F6)."""
    m, x = MinHasher(), np.random.default_rng(1).integers(0, 1 << 64, 400, np.uint64)

    def apart():
        return [(x * a + b).min() for a, b in zip(m.a, m.b)]

    def seconds(f):
        def once():
            t = time.perf_counter()
            for _ in range(100):
                f()
            return time.perf_counter() - t

        return min(once() for _ in range(5))

    assert seconds(lambda: m.of(x)) < seconds(apart) / 2
