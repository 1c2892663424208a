"""Periodic runs, SimHash components and the conversation trie against plain versions."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from llm_cases import documents

from mediaspark.llm import conversations, periodic, simhash

# --- periodic runs


def plain_runs(words):
    """All distances one after the other: stretches of equal pairs, the smallest period of each."""
    found = {}
    ids = np.array([hash(w) for w in words], np.int64)
    for q in range(1, len(ids) // 2 + 1):
        equal = np.concatenate([[False], ids[:-q] == ids[q:], [False]]).astype(int)
        starts, ends = np.flatnonzero(np.diff(equal) == 1), np.flatnonzero(np.diff(equal) == -1)
        for s, e in zip(starts.tolist(), (ends + q).tolist()):
            if e - s >= max(12, 2 * q):
                found.setdefault((s, e), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def periodic_words(rng, n):
    words = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 3:
            start, period = rng.randrange(n), rng.randint(1, max(1, n // 3))
            for i in range(start + period, min(n, start + rng.randint(1, n - start))):
                words[i] = words[i - period]
    return words


@pytest.mark.parametrize("segment", [1 << 16, 16])
def test_runs_equal_brute_force(segment, monkeypatch):
    monkeypatch.setattr(periodic, "SEGMENT", segment)
    rng = random.Random(segment)
    for _ in range(600):
        words = periodic_words(rng, rng.randint(0, rng.choice([20, 60, 250])))
        assert periodic.find_runs(np.array(words, np.int64)) == plain_runs(words), words


@pytest.mark.parametrize("period", [1, 2, 3, 5, 6, 7, 8, 14, 15, 31, 64])
def test_shortest_runs_at_all_offsets(period):
    """Each period just long enough and one word short of it, at all remainders of the blocks."""
    length = max(12, 2 * period)
    for offset in range(0, 70, 3):
        for n in (length - 1, length):
            words = [1000 + i for i in range(offset)] + [i % period for i in range(n)] + [5000 + i for i in range(40)]
            assert periodic.find_runs(np.array(words)) == ([(offset, n, period)] if n == length else [])


def test_long_runs_take_little_time():
    for words in ([0] * 60_000, [0, 1] * 30_000, list(range(20_000)) * 3):
        period = len(set(words))
        assert periodic.find_runs(np.array(words)) == [(0, len(words), period)]


def test_periodic_query(spark, edge, empty, tmp_path):
    rows = edge.collect()
    more = [(i, " ".join(f"w{k % (i + 7)}" for k in range(60)), "z") for i in range(100, 160)]
    docs = documents(spark, [(r["doc_id"], r["text"], r["source"]) for r in rows] + more)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, periodic.op11_periodic_runs(spark, str(tmp_path)).collect()))
    expected, planted = [], 0
    for doc_id, text in [(r["doc_id"], r["text"]) for r in docs.collect()]:
        words = (text or "").encode().split()
        h = zlib.crc32(str(doc_id).encode())
        n, g = len(words), h // 10
        if doc_id is not None and h % 10 == 0 and n:
            planted += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(((-length, s, q) for s, length, q in runs), default=None)
        top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
        expected.append((doc_id, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), n))
    names = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256 n_words".split()
    assert planted
    assert got == sorted(f"Row({', '.join(f'{k}={v!r}' for k, v in zip(names, row))})" for row in expected)
    assert periodic.periodic_runs(empty).count() == 0


def test_periodic_operator_gives_texts(spark):
    docs = documents(spark, [(1, "start " + "ha  HO\t" * 8 + "end", "a")])
    row = periodic.periodic_runs(docs).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 16, 2)]
    assert row["collapsed"] == "start ha HO end"


# --- SimHash


def plain_components(fps, limit):
    """Sets of linked fingerprints (unsigned), those of one left out."""
    fps = np.array(sorted(fps), np.uint64)
    label = np.arange(len(fps))
    for i in range(len(fps)):
        near = np.unique(label[np.bitwise_count(fps ^ fps[i]) <= limit])
        label[np.isin(label, near)] = near[0]
    groups = {}
    for fp, k in zip(fps.tolist(), label.tolist()):
        groups.setdefault(k, []).append(fp)
    return sorted(g for g in groups.values() if len(g) > 1)


def flipped(rng, fp, bits):
    for b in rng.sample(range(64), bits):
        fp ^= 1 << b
    return fp


def signed(fp):
    return fp - (1 << 64) if fp >> 63 else fp


def linked(spark, fps, limit, cell):
    rows = spark.createDataFrame([(signed(f),) for f in fps], "fp long").repartition(3)
    groups = {}
    for r in simhash.simhash_links(rows, limit, cell=cell).collect():
        groups.setdefault(r["component"], []).append(r["v"] % (1 << 64))
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("cell, limit", [(2048, 4), (32, 4), (2048, 1)])
def test_simhash_links_equal_brute_force(spark, cell, limit):
    rng = random.Random(cell + limit)
    fps = set()
    for _ in range(150):
        fp = rng.getrandbits(64)
        fps |= {fp} | {flipped(rng, fp, rng.randint(1, 7)) for _ in range(rng.randrange(4))}
    head = rng.getrandbits(64)
    fps |= {flipped(rng, head, rng.randint(1, 6)) for _ in range(400)}  # a family
    fps |= {rng.getrandbits(20) << 44 | 12345 for _ in range(200)}  # crowded low bits
    assert linked(spark, fps, limit, cell) == plain_components(fps, limit)


def test_thresholds_satisfy_the_principle(spark):
    """Each row's thresholds add up to limit - parts + 1, and correlated bits share a part."""
    rng = random.Random(8)
    fps = []
    for _ in range(3000):
        fp = rng.getrandbits(64)
        fps.append(signed(fp & ~(0xFF << 8) | (0xFF << 8) * (fp & 1)))  # bits 8 to 15 and 0 are the same
    plan = simhash.plan_for(spark.createDataFrame([(f,) for f in set(fps)], "fp long"), 4)
    thresholds, costs = plan.thresholds(simhash.bits_of(np.array(fps)))
    assert (thresholds.sum(axis=1) == 4 - len(plan.parts) + 1).all() and (thresholds >= -1).all() and np.isfinite(costs).all()
    assert sorted(b for p in plan.parts for b in p) == list(range(64))
    together = {0, *range(8, 16)}
    assert max(len(together & set(p)) for p in plan.parts) == len(together)


def test_fingerprints_equal_plain_majorities(spark, edge):
    got = [(r["doc_id"], r["fp"]) for r in simhash.fingerprints(edge).collect()]
    expected = []
    for r in edge.collect():
        words = (r["text"] or "").encode().lower().split()
        shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        fp = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        expected.append((r["doc_id"], signed(fp)))
    assert sorted(map(str, got)) == sorted(map(str, expected))


def test_simhash_components_of_texts(spark, edge, empty, prose):
    rng = random.Random(4)
    texts = prose(60, 3, 30, 90)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in edge.collect()]
    for i, t in enumerate(texts):
        words = t.split()
        rows.append((100 + 2 * i, t, "a"))
        words[rng.randrange(len(words))] = "changed"
        rows.append((101 + 2 * i, " ".join(words), "a"))
    docs = documents(spark, rows).repartition(3)
    got = simhash.simhash_components(docs).collect()
    fps = {r["fp"] % (1 << 64) for r in got}
    group = {fp: min(g) for g in plain_components(fps, 4) for fp in g}
    least = {}
    for r in got:
        if r["doc_id"] is not None:
            key = group.get(r["fp"] % (1 << 64), r["fp"] % (1 << 64))
            least[key] = min(r["doc_id"], least.get(key, r["doc_id"]))
    assert len(got) == len(rows) and any(len(g) > 1 for g in plain_components(fps, 4))
    for r in got:
        assert r["component_id"] == least.get(group.get(r["fp"] % (1 << 64), r["fp"] % (1 << 64)))
    # Null, empty and blank texts, ids 2 to 4 and a null one, share fingerprint zero.
    assert {r["component_id"] for r in got if r["fp"] == 0} == {2}
    assert simhash.simhash_components(empty).count() == 0


# --- conversations


def plain_trie(rows, rebuild=True):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs.setdefault(conv, []).append((turn is not None, turn or 0, tie, (role, text)))
    convs = {c: [t[3] for t in sorted(turns)] for c, turns in convs.items()}
    if rebuild:
        old, convs = convs, {}
        for c, own in old.items():
            h = zlib.crc32(str(c).encode()) % 6
            convs[c] = old.get(c - c % 100, [])[:h] + own[h:]
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, inside in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = {x[: len(node) + 1] for x in below if len(x) > len(node)}
        leaves = [x for x in below if not any(y[: len(x)] == x and len(y) > len(x) for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(str(c) for c in sorted(inside) if len(convs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(inside), len(node), parent, len(inside), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


SCHEMA = "conv_id long, turn long, role string, text string, conv long, pos long, digest string, depth long"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 5, 6, "x", 7) for r in rows], SCHEMA).repartition(3)


def conversations_like(rng, n):
    """Conversations with few different turns, so that prefixes are shared; some rows null, repeated or tied."""
    rows = []
    for c in rng.sample(range(0, 400), n):
        turns = [(rng.choice(["user", "assistant"]), rng.choice(["a", "b", "ünï", "long text 🙂"])) for _ in range(rng.choice([1, 1, 2, 3, 5, 9]))]
        if rng.random() < 0.3:
            turns = [("user", "a")] * len(turns)
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    rows += [(None, 0, "user", "a"), (1000, None, None, None), (1000, None, "user", "x"), (1000, 3, "user", "y"), (1000, 3, "user", "y"), (1001, 2, None, "z")]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_plain_version(spark, tmp_path, seed):
    rows = conversations_like(random.Random(seed), 120)
    turns_of(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = conversations.op13_conversation_trie(spark, str(tmp_path))
    expected = plain_trie(rows)
    assert sorted(str(tuple(r)) for r in got.collect()) == expected
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(str(r) for r in con.sql(conversations.OP13_SQL).fetchall()) == expected


def test_trie_without_rebuilding(spark):
    rows = conversations_like(random.Random(9), 60)
    got = conversations.prefix_trie(turns_of(spark, rows))
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_trie(rows, rebuild=False)


def test_trie_of_many_levels(spark):
    """Conversation i shares i turns with the next one: each chain hangs on the one before."""
    rows = [(c, d, "user", "s" if d < c else f"own {c}") for c in range(40) for d in range(c + 2)]
    got = conversations.prefix_trie(turns_of(spark, rows))
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_trie(rows, rebuild=False)


def test_ends_in_several_pieces(spark, monkeypatch):
    monkeypatch.setattr(conversations, "CHUNK", 50)
    rows = spark.createDataFrame([(1, c) for c in range(-20, 500)] + [(2, 7)], "k long, n long").repartition(4)
    got = {r["k"]: r["sha256"] for r in conversations.joined_digests(rows, ["k"], "n").collect()}
    assert got == {1: hashlib.sha256(",".join(map(str, range(-20, 500))).encode()).hexdigest(), 2: hashlib.sha256(b"7").hexdigest()}


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.prefix_trie(empty).count() == 0
