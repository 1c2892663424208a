"""The Hamming join against brute force where keys are short, long and crowded."""

import random

import pytest

from mediaspark.functions.scalars import to_signed
from mediaspark.operators import hamming
from mediaspark.operators.graph import components

MASK = 2**64 - 1


def near(values, distance):
    return {(a, b, ((a ^ b) & MASK).bit_count()) for a in values for b in values if a < b and ((a ^ b) & MASK).bit_count() <= distance}


def crowded(seed, n=500):
    """Families of near values, low-entropy values (three bytes of zeros in 30 % of them) and far ones."""
    rng = random.Random(seed)
    out = set()
    for _ in range(n // 10):
        base = rng.getrandbits(64)
        out |= {base ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 6))) for _ in range(4)}
    out |= {rng.getrandbits(40) << 24 for _ in range(n // 3)}
    out |= {rng.getrandbits(12) << 30 for _ in range(n // 5)}  # twelve bits in all
    head = rng.getrandbits(64)
    out |= {head ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 4))) for _ in range(n // 5)}
    return {to_signed(v) for v in out} | {0, -1, 2**62}


def table(spark, values):
    return spark.createDataFrame([(v,) for v in values] + [(None,), (0,)], "phash long").repartition(3)


@pytest.mark.parametrize("cell, distance", [(2048, 5), (24, 5), (8, 3), (24, 7), (24, 0)])
def test_pairs_equal_brute_force(spark, cell, distance):
    """Small cells send lists through all levels and into cells; each pair comes once."""
    values = crowded(cell + distance)
    got = [(r["a"], r["b"], r["distance"]) for r in hamming.hamming_join(table(spark, values), distance, cell=cell).collect()]
    assert len(got) == len(set(got))
    assert set(got) == near(values, distance)


@pytest.mark.parametrize("cell", [2048, 16])
def test_spanning_pairs_keep_components(spark, cell):
    values = crowded(cell)
    full = near(values, 5)
    got = hamming.hamming_join(table(spark, values), 5, spanning=True, cell=cell)
    few = {(r["a"], r["b"]) for r in got.collect()}
    assert few <= {(a, b) for a, b, _ in full}
    whole = spark.createDataFrame([(a, b) for a, b, _ in full], "a long, b long")
    assert {tuple(r) for r in components(got.select("a", "b")).collect()} == {tuple(r) for r in components(whole).collect()}
    if cell == 2048:
        assert len(few) < len(full) / 5


def test_no_task_gets_a_crowd(spark, monkeypatch):
    """Of 20,000 values a third share three zero bytes; no list that is compared holds more than a cell's two sides."""
    rng = random.Random(1)
    values = {rng.getrandbits(40) << 24 for _ in range(7_000)} | {rng.getrandbits(63) for _ in range(13_000)}
    rows = spark.createDataFrame([(v,) for v in map(to_signed, values)], "phash long")
    seen = spark.sparkContext.accumulator(0)
    plain = hamming._pairs

    def counted(lists, *rest):
        import numpy as np

        longest = int(np.bincount(lists).max())
        if longest > 1024:
            seen.add(1)
        return plain(lists, *rest)

    monkeypatch.setattr(hamming, "_pairs", counted)
    hamming.hamming_join(rows, 5, cell=512).count()
    assert seen.value == 0
