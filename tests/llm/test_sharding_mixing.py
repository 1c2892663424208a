import math
import zlib
from collections import Counter, defaultdict

import pytest
from llm_cases import documents, edge_rows
from pyspark.sql import functions as F

from mediaspark.llm import mixing, sharding


def test_shards_equal_brute_force(spark, edge):
    got = sharding.shard_by_bytes(edge, shards=5).collect()
    rows = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in edge_rows()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))
    total, before, want, slots = sum(r[1] for r in rows), 0, [], Counter()
    for i, size, crc in rows:
        shard = min(4, (2 * before + size) * 5 // (2 * total))
        want.append((i, size, crc, shard, slots[shard]))
        slots[shard] += 1
        before += size
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_shards_are_balanced_and_contiguous(spark, prose):
    docs = documents(spark, [(i, t, "a") for i, t in enumerate(prose(3000))]).repartition(7)
    got = sharding.shard_by_bytes(docs).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert set(sizes) == set(range(24))
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in got)
    by_id = sorted(got, key=lambda r: r.doc_id)
    assert [r.shard for r in by_id] == sorted(r.shard for r in by_id)
    for s in range(24):
        assert [r.slot for r in by_id if r.shard == s] == list(range(sum(r.shard == s for r in got)))


def test_a_hot_id_is_split(spark):
    docs = documents(spark, [(1, f"same id {i}", "a") for i in range(400)] + [(i, "x", "b") for i in range(2, 100)])
    got = sharding.shard_by_bytes(docs, shards=8).collect()
    assert len(got) == 498 and len({r.shard for r in got}) == 8


def test_empty_tables(spark, empty):
    assert sharding.shard_by_bytes(empty).count() == 0
    assert mixing.mix(empty, mixing.words()).count() == 0


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        unit = left / sum(w[s] for s in free) if free else 0
        over = {s for s in free if unit * w[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else unit * w[s] for s in names}
        full |= over


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_matches_targets(spark, prose, seed):
    texts = prose(1500, seed)
    source = lambda i: None if i % 50 == 3 else "hot" if i % 3 == 0 else f"s{i % 7}é"
    docs = documents(spark, [(i, t, source(i)) for i, t in enumerate(texts)]).repartition(5)
    got = mixing.mix(docs, mixing.words()).collect()
    sizes, longest, taken = Counter(), Counter(), Counter()
    for i, t in enumerate(texts):
        sizes[source(i)] += len(t.split())
        longest[source(i)] = max(longest[source(i)], len(t.split()))
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9)
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s] + 1
    again = mixing.mix(docs.repartition(3), mixing.words()).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in again)


def test_mix_bears_edges(spark, edge):
    got = mixing.mix(edge, mixing.words()).collect()
    assert len(got) == len(edge_rows())
    by = defaultdict(int)
    for r in got:
        by[r.source] = r.source_size
    sizes = Counter()
    for _, t, s in edge_rows():
        sizes[s] += len((t or "").encode().split())
    assert by == dict(sizes)


def test_systematic_sampling_takes_whole_crossings(spark):
    docs = documents(spark, [(i, "w " * 10, "a") for i in range(100)] + [(1000 + i, "w " * 10, "b") for i in range(100)])
    got = mixing.mix(docs, mixing.words(), weights=(3, 1)).groupBy("source").agg(F.sum("copies").alias("n")).collect()
    assert {r.source: r.n for r in got} in ({"a": 150, "b": 50}, {"a": 150, "b": 51}, {"a": 151, "b": 50}, {"a": 150, "b": 49}, {"a": 149, "b": 50})
