"""Counting quotient filters against plain counting."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from citadine.llm import exact, quotient


def counted(rng, n, bits, distinct):
    pool = rng.integers(0, 2**bits if bits < 63 else 2**63, distinct).astype(np.uint64)
    return pool[np.minimum(rng.geometric(3 / distinct, n) - 1, distinct - 1)] if distinct > 3 else rng.choice(pool, n)


@pytest.mark.parametrize("bits", [6, 17, 48, 64])
def test_entries_are_the_counted_fingerprints(bits):
    rng = np.random.default_rng(bits)
    for n, distinct in ((1, 1), (2, 2), (100, 7), (5000, 1000), (300, 300)):
        own = counted(rng, n, bits, distinct)
        keys, counts = quotient.filled(own, bits).entries()
        assert dict(zip(keys.tolist(), counts.tolist())) == Counter(own.tolist()) and (keys[1:] > keys[:-1]).all()


def test_merges_lose_nothing_in_any_order():
    rng = np.random.default_rng(1)
    parts = [counted(rng, n, 20, 500) for n in (1, 3000, 40, 700, 9)]
    want = Counter(np.concatenate(parts).tolist())
    for order in ([0, 1, 2, 3, 4], [4, 2, 0, 3, 1]):
        keys, counts = quotient.merged([quotient.filled(parts[i], 20) for i in order]).entries()
        assert dict(zip(keys.tolist(), counts.tolist())) == want
    slabs = quotient.merged([quotient.filled(p, 20) for p in parts]).parts(5)
    again = {(slab << 15) | k: c for slab, f in slabs for k, c in zip(*(x.tolist() for x in f.entries()))}
    assert again == want


def test_large_counts_and_size():
    one = quotient.Filter.of(np.array([3, 9], np.uint64), np.array([1, 10**12]), 48)
    for _ in range(3):
        one = one.merge(one)
    assert one.entries()[1].tolist() == [8, 8 * 10**12]
    many = quotient.filled(np.random.default_rng(2).integers(0, 2**48, 1 << 16).astype(np.uint64), 48)
    assert sum(len(x) for x in (many.occupied, many.run_ends, many.remainders, many.repeated, many.counters)) < 4.6 * many.size  # 48 - 16 + 3 bits


def test_repeated_fingerprints(spark):
    rng = np.random.default_rng(3)
    own = [int(x) for x in np.concatenate([rng.integers(0, 2**48, 3000), np.repeat(rng.integers(0, 2**48, 50), 40), np.repeat([0, 2**48 - 1], 2)])]
    got = exact.repeated_fingerprints(spark.createDataFrame([(x,) for x in own], "fp long").repartition(5))
    assert {r["fp"]: r["n"] for r in got.collect()} == {k: n for k, n in Counter(own).items() if n > 1}
    marked = {(r["word"] << 6) + b for r in exact.marks(got).collect() for b in range(64) if r["mask"] >> b & 1}
    assert marked == {k >> (exact.BITS - exact.MARKS) for k, n in Counter(own).items() if n > 1}
    assert exact.repeated_fingerprints(spark.createDataFrame([], "fp long")).collect() == []


def test_texts_that_share_a_fingerprint_part_in_the_verification(spark, monkeypatch):
    """With fingerprints of three bits nearly all texts collide."""
    monkeypatch.setattr(exact, "BITS", 3)
    monkeypatch.setattr(exact, "MARKS", 3)
    monkeypatch.setattr(exact.repeated_fingerprints, "__defaults__", ("fp", 3))
    monkeypatch.setattr(exact.marks, "__defaults__", (3, 3))
    rows = [(k, f"text {k % 20}" if k < 60 else f"alone {k}") for k in range(100)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact.op3(spark.createDataFrame(rows, "doc_id long, text string").withColumn("x", F.lit(1))).collect()}
    assert got == {k: (k % 20 + 40, 3) if k < 60 else (k, 1) for k in range(100)}
