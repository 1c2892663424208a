import itertools
import random
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken
from llm_cases import documents, edge_rows
from pyspark.sql import functions as F

import corpus_pipeline
from mediaspark.llm import bpe, jaccard, mixing, quality_rules, toxicity
from mediaspark.llm.components import _state, connected_components


def shingles(text, width):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    k = min(width, len(w))
    return {(k, *w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_components(rows, percent, width):
    """Least id in reach for each row, by all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                same = len(sets[i] & sets[j])
                if 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
                    label[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            groups[find(i)] = min(groups.get(find(i), d), d)
    return [(d, len(sets[i]), groups.get(find(i)), find(i)) for i, (d, _) in enumerate(rows)]


def families(seed, n=260):
    """Near copies with few and many edits, shared passages, and texts of their own."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = rng.choices(words, k=25)
    bases = [rng.choices(words, k=rng.randint(8, 70)) for _ in range(6)]
    out = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.65:
            t = list(bases[min(rng.randint(0, 9), 5)])
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                t[rng.randrange(len(t))] = rng.choice(words)
        else:
            t = rng.choices(words, k=rng.randint(1, 40)) + (passage if kind < 0.85 else [])
        out.append((i, " ".join(t)))
    return out


@pytest.mark.parametrize("percent,width,seed", [(90, 3, 1), (80, 5, 2), (80, 2, 3), (60, 1, 4)])
def test_components_equal_all_pairs(spark, percent, width, seed):
    rows = families(seed)
    docs = documents(spark, [(i, t, "a") for i, t in rows]).repartition(5)
    got = jaccard.jaccard_components(docs, percent, width, rare=4).collect()
    want = {d: (n, c) for d, n, c, _ in brute_components(rows, percent, width)}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


@pytest.mark.parametrize("percent", [51, 66, 67])
def test_small_sets_of_frequent_tokens(spark, percent):
    """Sets that may have no two neighbouring tokens in common, whatever the order of tokens."""
    words = [f"c{i}" for i in range(7)]
    rows = [" ".join(c) for k in (2, 3, 4) for c in itertools.combinations(words, k)]
    rows = list(enumerate(random.Random(5).sample(rows, 40)))
    docs = documents(spark, [(i, t, "a") for i, t in rows])
    want = {d: c for d, _, c, _ in brute_components(rows, percent, 1)}
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs, percent, 1, rare=1).collect()} == want
    few = [(0, "c1 c2")] + [(i, f"c1 p{i} c2") for i in range(1, 9)] + [(10 + i, f"p{i} {' '.join(f'z{i}x{k}' for k in range(5))}") for i in range(1, 9)]
    docs = documents(spark, [(i, t, "a") for i, t in few])
    want = {d: c for d, _, c, _ in brute_components(few, percent, 1)}
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs, percent, 1, rare=1).collect()} == want


def test_edges(spark, edge, empty):
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard.jaccard_components(edge).collect())
    want = sorted((d or -1, n, c or -1) for d, n, c, _ in brute_components([(i, t) for i, t, _ in edge_rows()], 90, 3))
    assert got == want
    assert jaccard.jaccard_components(empty).count() == 0


def test_links_are_real(spark):
    rows = families(7)
    docs = documents(spark, [(i, t, "a") for i, t in rows])
    documents_, _, links, _ = jaccard.jaccard_links(docs, rare=4)
    text = {r.row: rows[r.doc_id][1] for r in documents_.collect()}
    for r in links.collect():
        x, y = shingles(text[r.a], 3), shingles(text[r.b], 3)
        assert 100 * len(x & y) >= 90 * len(x | y)


@pytest.mark.parametrize("cell", [150, 1 << 16])
def test_links_are_counted_exactly(spark, monkeypatch, cell):
    """Each text's number of similar other texts, within groups cut in many parts or none."""
    monkeypatch.setattr(jaccard, "CELL_TOKENS", cell)
    rows = families(9, 140) + [(900, ""), (901, "one"), (902, "one")]
    docs = documents(spark, [(i, t, "a") for i, t in rows]).repartition(3)
    sets = {t: shingles(t, 2) for _, t in rows}
    texts = {frozenset(s) for s in sets.values() if s}
    want = {i: sum(s != sets[t] and 100 * len(s & sets[t]) >= 80 * len(s | sets[t]) for s in texts) for i, t in rows}
    got = jaccard.link_counts(docs, 80, 2, rare=4).collect()
    assert {r.doc_id: r.n_links for r in got} == want and max(want.values()) > 5


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(rng.randint(2000, 2200), rng.randint(2000, 2200)) for _ in range(120)]
    got = {r.v: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {v: v for e in edges for v in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    linked = {v for e in edges if e[0] != e[1] for v in e}
    assert got == {v: c for v, c in label.items() if v in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_pipeline(spark, folder):
    """The stages over plain lists."""
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), toxicity.training_rows(spark.read.parquet(f"{folder}/labels.parquet")))
    memory = toxicity.lookup({f: i for i, f in enumerate(model.features)})

    def toxic(text):
        found = sorted(toxicity.found(text.encode(), memory))
        return 1 / (1 + 2.718281828459045 ** -(model.bias + sum(model.weights[i] for i in found)))

    docs = [d for d in docs if toxic(d[1]) < toxicity.THRESHOLD]
    names = [x.split()[0] for x in quality_rules.MEASURES.split(", ")]
    fails = lambda d: any(eval(r.fails.replace("AND", "and"), {}, dict(zip(names, quality_rules.measure(d[1].encode())))) for r in quality_rules.RULES)
    docs = sorted((d for d in docs if not fails(d)))
    group = brute_components([(d[0], d[1]) for d in docs], 80, 5)
    docs = [d for d, g in zip(docs, group) if d[0] == g[2]]
    rows = spark.createDataFrame([(d[0], d[3], len(d[1].encode().split()), i) for i, d in enumerate(docs)], "doc_id long, source string, size long, row long")
    copies = {r.doc_id: r.copies for r in mixing.copies_of(rows).collect()}
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(f.read()), special_tokens={})
    return Counter({(d[0], tuple(enc.encode_ordinary(d[1]))): copies[d[0]] for d in docs if copies[d[0]]})


def test_pipeline_equals_plain_version(spark):
    folder = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, folder).collect()
    assert all(r.intact for r in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == plain_pipeline(spark, folder)


def test_stages_bear_edges(spark, edge, empty):
    for docs in (edge, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            rows = out.count()
            assert rows == 0 or docs is edge, name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns


def test_edge_checksum_does_not_overflow(spark):
    edges = spark.range(20_000_000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert _state(edges)[0] == 20_000_000
    assert _state(edges) == _state(edges.repartition(7)) != _state(edges.withColumn("v", F.col("v") + 1))


def template_pages(n, extra, kinds=1, seed=11):
    """Pages of a template and words of their own, with 90 per cent or less in common; some pages of the bare template."""
    rng = random.Random(seed)
    template = [f"t{i}" for i in range(200)]
    out = []
    for i in range(n):
        t = list(template)
        for _ in range(i % kinds):
            t[rng.randrange(len(t))] = f"r{i % 7}"
        out.append((i, " ".join(t + [f"own{i}x{k}" for k in range(extra[i % len(extra)])])))
    return out


@pytest.mark.parametrize("extra,kinds", [((24, 30), 1), ((0, 3, 24, 12, 30, 20, 8), 1), ((0, 6, 14, 24, 40), 4)])
def test_pages_of_a_template(spark, extra, kinds):
    rows = template_pages(150, extra, kinds)
    docs = documents(spark, [(i, t, "a") for i, t in rows]).repartition(3)
    want = {d: (n, c) for d, n, c, _ in brute_components(rows, 90, 3)}
    got = jaccard.jaccard_components(docs, rare=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_strays_of_a_family_are_not_paired_with_all_its_members(spark, monkeypatch):
    """Sets of frequent tokens alone that share too few with the head of their lists, beside the head's family."""
    rng = random.Random(5)
    base, other = [f"b{i}" for i in range(200)], [f"o{i}" for i in range(60)]
    texts = [" ".join(base)]
    for i in range(40):
        gone = set(rng.sample(range(200), 3))
        texts.append(" ".join(w for k, w in enumerate(base) if k not in gone))
    strays = len(texts)
    for i in range(40):
        gone, new = set(rng.sample(range(200), 30)), rng.sample(other, 30)
        texts.append(" ".join([w for k, w in enumerate(base) if k not in gone] + new))
    texts.append(" ".join(texts[-1].split()[:-1]))
    docs = documents(spark, [(i, t, "a") for i, t in enumerate(texts)]).repartition(3)
    pairs = []
    staged = jaccard.staged

    def watched(df, name, *rest):
        out = staged(df, name, *rest)
        if name == "late":
            pairs.extend((r.a, r.b) for r in out.collect())
        return out

    monkeypatch.setattr(jaccard, "staged", watched)
    numbered = docs.withColumn("r", F.col("doc_id"))
    rows = {r.doc_id: r.component_id for r in jaccard.jaccard_components(numbered, width=1, rare=3, row_col="r").collect()}
    sets = [set(t.split()) for t in texts]
    want = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    want[a] = want[b] = min(want[a], want[b])
    assert [rows[i] for i in range(len(texts))] == want
    assert not [x for x in pairs if min(x) < strays <= max(x)]
