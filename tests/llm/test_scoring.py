import math
import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import documents, edge_rows
from pyspark.sql import functions as F

from mediaspark.llm import bm25, ppm, pu_quality, toxicity


def brute_ppm(train, texts):
    counts = [defaultdict(Counter) for _ in range(4)]
    for t in train:
        s = b"\xff\xff\xff" + t.lower() + b"\xff"
        for i in range(3, len(s)):
            for k in range(4):
                counts[k][s[i - k : i]][s[i]] += 1
    out = []
    for t in texts:
        s, total = b"\xff\xff\xff" + t.lower() + b"\xff", 0.0
        for i in range(3, len(s)):
            excluded = set()
            for k in (3, 2, 1, 0):
                c = {b: n for b, n in counts[k].get(s[i - k : i], {}).items() if b not in excluded}
                if not c:
                    continue
                whole, kinds = sum(c.values()), len(c)
                if s[i] in c:
                    total += math.log10(c[s[i]] / (whole + kinds))
                    break
                total += math.log10(kinds / (whole + kinds))
                excluded |= set(c)
            else:
                total -= math.log10(256 - len(counts[0].get(b"", ())))
        out.append(total)
    return out


def test_ppm_and_base_equal_brute_force(spark, prose):
    texts = [t.replace("a", "Aé\n", 2) for t in prose(60, 3, 0, 25)] + [t or "" for _, t, _ in edge_rows() if len(t or "") < 1000]
    docs = documents(spark, [(i, t, "a") for i, t in enumerate(texts)]).repartition(3)
    # A low max_common sends most words through the join.
    rows = {r.doc_id: r for r in ppm.score(docs, F.col("doc_id") % 3 != 0, max_contexts=10**6, max_common=10).collect()}
    train = [t.encode() for i, t in enumerate(texts) if i % 3]
    want = brute_ppm(train, [t.encode() for t in texts])
    words = Counter(w for t in train for w in [*t.lower().split(), b""])
    n, v = sum(words.values()), len(words)
    for i, t in enumerate(texts):
        tokens = [*t.encode().lower().split(), b""]
        assert rows[i].n_tokens == len(tokens) and rows[i].train_tokens == n
        assert rows[i].n_known == sum(w in words for w in tokens)
        assert rows[i].base_score == pytest.approx(sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens), abs=1e-6)
        assert rows[i].score == pytest.approx(want[i], rel=1e-5, abs=1e-4)


@pytest.mark.parametrize("max_contexts", [ppm.MAX_CONTEXTS, 20, 1])
def test_ppm_codes_all_contexts(spark, prose, max_contexts):
    """Also after contexts too rare to be kept."""
    rare = [f"x{chr(0xE0 + i % 30)}q{chr(97 + i % 7)}{i}" for i in range(90)] + ["漢字 🙂 漢字", ""]
    texts = [*prose(150, 4, 50, 200), *rare, "hot " * 8000]
    docs = documents(spark, [(i, t, "a") for i, t in enumerate(texts)]).repartition(3)
    rows = {r.doc_id: r.score for r in ppm.score(docs, F.col("doc_id") % 3 != 0, max_contexts=max_contexts).collect()}
    want = brute_ppm([t.encode() for i, t in enumerate(texts) if i % 3], [t.encode() for t in texts])
    for i in range(len(texts)):
        assert rows[i] == pytest.approx(want[i], rel=1e-5, abs=1e-4)


def test_ppm_counting_a_text_does_not_walk_all_words():
    class Counts(Counter):
        def __iter__(self):
            raise AssertionError("walked")

    counts = Counts()
    assert ppm.count_words(b"One two  one", counts) == 6 + 2 * 150
    assert ppm.count_words(b"two three", counts) == 5 + 150
    assert dict(counts.items()) == {b"one": 2, b"two": 2, b"three": 1, b"": 2}


def test_ppm_pruned_is_a_distribution():
    codes, counts = ppm.grams([b"abracadabra", b"banana bandana", b"", b"cabbage"])

    def level(w):
        u, i = np.unique(codes.astype(np.int64) & ((1 << (8 * (w + 1))) - 1), return_inverse=True)
        return u, np.bincount(i, counts).astype(float)

    c3, n3 = level(3)
    few = np.isin(c3 >> 8, (c3 >> 8)[:4])
    trie = ppm.Trie.build(c3[few], n3[few], level(2), level(1))
    p = 10.0 ** trie.logp.astype(float)
    unseen = 256 - (trie.size - 1)
    assert np.allclose(p[:, :-1].sum(1) + unseen * p[:, -1], 1, atol=1e-4)


def test_ppm_bears_empty_tables(spark, empty, edge):
    assert ppm.score(empty, F.lit(True)).count() == 0
    rows = ppm.score(edge, F.lit(False)).collect()  # nothing to learn from
    assert len(rows) == len(edge_rows()) and all(r.n_known == 0 and r.score < 0 for r in rows)


def brute_bm25(texts, queries, k):
    counts = [Counter(t.encode().lower().split()) for t in texts]
    n, df = len(counts), Counter()
    for c in counts:
        df.update(c.keys())
    length = [sum(c.values()) for c in counts]
    mean = sum(length) / n
    out = {}
    for q in queries:
        scores = []
        for d, c in enumerate(counts):
            norm = 1.2 * (0.25 + 0.75 * length[d] / mean)
            s = sum(f * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] / (c[w] + norm) for w, f in counts[q].items() if w in c)
            if s > 0:
                scores.append((-round(s, 6), d))
        out[q] = sorted(scores)[:k]
    return out


def test_bm25_equals_brute_force(spark, prose):
    texts = prose(600, 9) + [""] * 3
    texts[50] = texts[10]
    docs = documents(spark, [(i, t, "a") for i, t in enumerate(texts)]).repartition(4)
    got = defaultdict(list)
    for r in bm25.top_k(docs, F.col("doc_id") % 20 == 0, k=7, shard_postings=4000).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, r.score))
    want = brute_bm25(texts, range(0, len(texts), 20), 7)
    for q, rows in want.items():
        assert [d for _, d in rows] == [d for d, _ in got.get(q, [])]
        assert np.allclose([-s for s, _ in rows], [s for _, s in got.get(q, [])], atol=2e-6)


def test_bm25_bears_edges(spark, edge, empty):
    assert bm25.top_k(empty, F.lit(True)).count() == 0
    rows = bm25.top_k(edge, F.lit(True), k=3).collect()
    assert {r.query_id for r in rows} >= {1, 5, 6, 7, 8, 9, 10} and not {2, 3, 4} & {r.query_id for r in rows}
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.rank) if r.query_id == 1] == [1, 7, 7]


def accuracy(rows, column, held):
    hit = [(r[column] == 1) == (r.predicted == 1) for r in rows if r.held_out == held and r[column] is not None]
    return sum(hit) / len(hit)


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.op3_toxicity(spark, folder).join(labels, "doc_id").collect()
    assert accuracy(rows, "toxic", True) > 0.96
    good = [r for r in rows if r.held_out and r.predicted == 1]
    assert sum(r.toxic for r in good) / len(good) > 0.95


def test_toxic_words_in_long_tokens_are_found():
    votes = toxicity.Votes(["wmarker"])
    glued = b"https://example.org/some-quite-long-path/of-an-IDIOT.and_a-stupid/marker?x=1"
    assert len(glued.split()[0]) > toxicity.LONG and votes(glued) == votes(b"idiot stupid marker") != votes(b"")
    plain = "的" * 50
    assert toxicity.features_of(f"{plain}。marker".encode())[-1] == "pmarke" and "w" + plain in toxicity.features_of(plain.encode())


def plain_label_model(votes, pos, neg, rounds=20):
    """EM text by text: rates from labelled texts first, then from posteriors of all and the labels."""
    x, g, y = votes, np.concatenate([pos, neg]), np.concatenate([np.ones(len(pos)), np.zeros(len(neg))])
    prior = (len(pos) + 1) / (len(g) + 2)
    scale = min(1.0, len(g) / len(x))
    start = prior

    def rates(r, c):
        out = np.zeros((2, x.shape[1]))
        for k in (0, 1):
            for v in range(x.shape[1]):
                own = sum(c * (r[i] if k else 1 - r[i]) * x[i, v] for i in range(len(x)))
                labelled = sum(g[i, v] for i in range(len(g)) if y[i] == k)
                whole = sum(c * (r[i] if k else 1 - r[i]) for i in range(len(x))) + (y == k).sum()
                out[k, v] = min(max((own + labelled + 0.5 * start) / (whole + 1), 1e-4), 1 - 1e-4)
        return out

    theta, weights = rates(np.zeros(len(x)), 0.0), np.ones(x.shape[1])
    for _ in range(rounds):
        r = []
        for row in x:
            odds = np.log(prior / (1 - prior))
            for v, bit in enumerate(row):
                odds += weights[v] * np.log((theta[1, v] if bit else 1 - theta[1, v]) / (theta[0, v] if bit else 1 - theta[0, v]))
            r.append(1 / (1 + np.exp(-min(30, max(-30, odds)))))
        r = np.array(r)
        theta = rates(r, scale)
        prior = min(max((scale * r.sum() + len(pos) + 1) / (scale * len(x) + len(g) + 2), 1e-3), 0.999)
        cov = np.zeros((x.shape[1],) * 2)
        for row, p in zip(x, r):
            cov += scale * (p * np.outer(row - theta[1], row - theta[1]) + (1 - p) * np.outer(row - theta[0], row - theta[0]))
        for row, k in zip(g, y):
            cov += np.outer(row - theta[int(k)], row - theta[int(k)])
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        off = np.clip(cov / np.outer(sd, sd), 0, 1)
        np.fill_diagonal(off, 0)
        weights = 1 / (1 + off.sum(1))
    return theta, prior, weights


def test_label_model_equals_plain_em():
    rng = np.random.default_rng(8)
    y = rng.random(300) < 0.3
    x = (rng.random((300, toxicity.VOTERS)) < np.where(y[:, None], 0.4, 0.05)).astype(float)
    x[:, 3] = x[:, 2]
    bits = (x.astype(int) << np.arange(toxicity.VOTERS)).sum(1)
    patterns, counts = np.unique(bits, return_counts=True)
    gold, at = np.unique(bits[:60], return_inverse=True)
    m = toxicity.fit_label_model(
        patterns, counts.astype(float), gold, np.bincount(at, y[:60]).astype(float), np.bincount(at, ~y[:60]).astype(float)
    )
    theta, prior, weights = plain_label_model(x, x[:60][y[:60]], x[:60][~y[:60]])
    assert np.allclose(m.rates, theta, atol=1e-6) and abs(m.prior - prior) < 1e-6 and np.allclose(m.weights, weights, atol=1e-6)


def test_toxicity_equals_a_plain_version(spark, prose):
    """All votes, posteriors and the classifier's weights, from lists; the labels' texts are few among many."""
    rng = np.random.default_rng(6)
    toxic_words = ["idiot", "moron", "zorgish", "blarfen", "zorgly"]
    rows = []
    for i, t in enumerate(prose(900, 12, 10, 60)):
        bad = rng.random() < 0.2
        rows.append((i, t + "".join(f" {w}" for w in rng.choice(toxic_words, rng.integers(1, 4)) if bad) + (" !!" if bad and i % 3 else ""), int(bad)))
    docs = documents(spark, [(i, t, "a") for i, t, _ in rows]).repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:250]], "doc_id long, toxic int")
    m = toxicity.fit(docs, labels)
    # The lexicon: features of enough toxic texts, mostly of toxic ones, and beyond chance.
    held, held_bad = Counter(), Counter()
    for _, t, y in rows[:250]:
        for f in {f for w in t.lower().encode().split() for f in toxicity.features_of(w)}:
            held[f] += 1
            held_bad[f] += y
    n_pos = sum(y for _, _, y in rows[:250])
    share = n_pos / 250
    mined = {
        f for f in held
        if held_bad[f] >= 4 and held_bad[f] >= 0.6 * held[f] and held_bad[f] - share * held[f] >= 5 * (held[f] * share * (1 - share)) ** 0.5
    }
    fixed = {"w" + w for g in toxicity.LEXICON for w in g}
    assert set(m.features) == mined | fixed and {"wzorgish", "pzorg", "wblarfen"} <= mined
    votes = toxicity.Votes([f for f in m.features if f not in fixed])
    at = {f: i for i, f in enumerate(m.features)}
    assert votes.index == at
    bits, x = zip(*[votes(t.encode()) for _, t, _ in rows])
    gold, place = np.unique(bits[:250], return_inverse=True)
    y = np.array([r[2] for r in rows[:250]], float)
    patterns, counts = np.unique(bits, return_counts=True)
    label_model = toxicity.fit_label_model(patterns, counts.astype(float), gold, np.bincount(place, y), np.bincount(place, 1 - y))
    r = label_model.posterior(toxicity.unpack(np.array(bits)))
    dense = np.zeros((len(rows), len(at) + 1))
    for i, ids in enumerate(x):
        dense[i, ids] = 1
    dense[:, -1] = 1
    clean, toxic = toxicity.class_weights(r.mean())
    weight = r * toxic + (1 - r) * clean
    w = np.append(m.weights, m.bias)
    s = 1 / (1 + np.exp(-(dense @ w)))
    gradient = dense.T @ (weight * (s - r)) / len(rows) + 3e-4 * np.append(w[:-1], 0)
    assert np.abs(gradient).max() < 2e-3  # at the minimum of the convex loss on all posteriors
    loss = lambda w: (weight * (np.logaddexp(0, dense @ w) - r * (dense @ w))).mean() + 1.5e-4 * w[:-1] @ w[:-1]
    best = w.copy()
    for _ in range(4000):
        s = 1 / (1 + np.exp(-(dense @ best)))
        best -= 0.5 * (dense.T @ (weight * (s - r)) / len(rows) + 3e-4 * np.append(best[:-1], 0))
    assert loss(w) <= loss(best) + 1e-4
    got = {q.doc_id: q.score for q in toxicity.score(docs, m).collect()}
    assert all(abs(got[i] - 1 / (1 + np.exp(-dense[i] @ w))) < 1e-9 for i in range(len(rows)))
    unlabelled = [got[i] > 0.7 for i in range(250, 900)]
    assert np.mean([a == (rows[i + 250][2] == 1) for i, a in enumerate(unlabelled)]) > 0.97


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.2
    rate1, rate0 = np.linspace(0.3, 0.9, toxicity.VOTERS), np.linspace(0.1, 0.02, toxicity.VOTERS)
    x = rng.random((len(y), toxicity.VOTERS)) < np.where(y[:, None], rate1, rate0)
    x[:, 1] = x[:, 0]  # one voter copies another
    bits = (x << np.arange(toxicity.VOTERS)).sum(1)
    patterns, counts = np.unique(bits, return_counts=True)
    gold, at = np.unique(bits[:500], return_inverse=True)
    pos, neg = np.bincount(at, y[:500]), np.bincount(at, ~y[:500])
    m = toxicity.fit_label_model(patterns, counts.astype(float), gold, pos, neg)
    assert np.abs(m.rates[1][2:] - rate1[2:]).max() < 0.1 and np.abs(m.rates[0][2:] - rate0[2:]).max() < 0.05
    assert m.correlations[0, 1] > 0.9 and m.weights[0] < 0.65 < m.weights[5]


def test_scores_bear_edges(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 1), (99, 1, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for docs, n in ((edge, len(edge_rows())), (empty, 0)):
        for rows in (labels, labels.limit(0)):
            m = toxicity.fit(docs, rows)
            got = toxicity.score(docs, m, keep=("doc_id", "score", "t")).toDF("doc_id", "own", "t", "toxicity").collect()
            assert len(got) == n and all(0 <= r.toxicity <= 1 for r in got)
            q = pu_quality.score(docs, pu_quality.fit(docs, rows)).collect()
            assert len(q) == n and all(0 <= r.score <= 1 for r in q)


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = pu_quality.op10_pu_quality(spark, folder).join(labels, "doc_id").collect()
    assert accuracy(rows, "quality", True) > 0.97


def local_sums(positive, rows):
    """Sums over arrays, as fit() has them over a table."""
    a, b = positive[::2], positive[1::2]

    def sums(mean, scale, w):
        return [pu_quality.risk_sums(pu_quality.standardised(x, mean, scale), w) for x in (rows, positive, a, b)]

    return sums


def plain_nnpu(p, u, prior, decay=1e-3, rounds=30_000, rate=0.2):
    """The non-negative risk step by step: against the gradient of the whole risk, or up that of a negative part under 0."""
    w = np.zeros(p.shape[1] + 1)
    p, u = (np.column_stack([x, np.ones(len(x))]) for x in (p, u))
    s = lambda z: 1 / (1 + np.exp(-z))
    for _ in range(rounds):
        negative = np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
        g_pos = prior * ((s(p @ w) - 1) @ p) / len(p)
        g_neg = s(u @ w) @ u / len(u) - prior * (s(p @ w) @ p) / len(p)
        w -= rate * ((g_pos + g_neg if negative >= 0 else -g_neg) + decay * np.append(w[:-1], 0))
    return w


def test_nnpu_equals_plain_steps_and_needs_no_negatives():
    rng = np.random.default_rng(1)
    make = lambda n, mean: rng.normal(mean, 1.0, (n, 3))
    positive, rows = make(500, 1.5), np.concatenate([make(1400, 1.5), make(600, -1.5)])
    mean, scale = rows.mean(0), rows.std(0)
    w = pu_quality.train_nnpu(local_sums(positive, rows), 0.7, mean, scale)
    want = plain_nnpu(pu_quality.standardised(positive, mean, scale), pu_quality.standardised(rows, mean, scale), 0.7)
    assert np.allclose(w, want, atol=0.02)
    m = pu_quality.QualityModel(mean, scale, w[:-1], w[-1], 0.7)
    assert (m.score(make(500, 1.5)) > 0.5).mean() > 0.95 and (m.score(make(500, -1.5)) < 0.5).mean() > 0.95


def nn_risk(p, u, prior, w, decay=1e-3):
    p, u = (np.column_stack([x, np.ones(len(x))]) for x in (p, u))
    negative = np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
    return prior * np.logaddexp(0, -(p @ w)).mean() + max(0.0, negative) + decay / 2 * w[:-1] @ w[:-1]


@pytest.mark.parametrize("n, k, prior", [(40, 26, 0.3), (40, 26, 0.7), (100, 26, 0.5), (200, 26, 0.9), (60, 3, 0.95)])
def test_nnpu_reaches_the_least_risk_where_the_bound_binds(n, k, prior):
    """Subgradient steps on the same risk, with falling rates, find none that is lower by over a hundredth."""
    rng = np.random.default_rng(n + k)
    positive = rng.normal(0.4, 1.0, (n, k))
    rows = np.concatenate([rng.normal(0.4, 1.0, (int(400 * prior), k)), rng.normal(-0.4, 1.0, (400 - int(400 * prior), k))])
    mean, scale = rows.mean(0), rows.std(0)
    w = pu_quality.train_nnpu(local_sums(positive, rows), prior, mean, scale)
    p, u = pu_quality.standardised(positive, mean, scale), pu_quality.standardised(rows, mean, scale)
    least, v = np.inf, np.zeros(k + 1)
    s = lambda z: 1 / (1 + np.exp(-z))
    p1, u1 = (np.column_stack([x, np.ones(len(x))]) for x in (p, u))
    bound = False
    for t in range(20_000):
        negative = np.logaddexp(0, u1 @ v).mean() - prior * np.logaddexp(0, p1 @ v).mean()
        bound |= negative < 0
        g = prior * ((s(p1 @ v) - 1) @ p1) / len(p1) + 1e-3 * np.append(v[:-1], 0)
        if negative >= 0:
            g = g + s(u1 @ v) @ u1 / len(u1) - prior * (s(p1 @ v) @ p1) / len(p1)
        v = v - 0.5 / (1 + t / 200) ** 0.75 * g
        least = min(least, nn_risk(p, u, prior, v))
    assert bound and nn_risk(p, u, prior, w) <= 1.01 * least


def test_sums_reach_the_driver_in_few_vectors(spark):
    from mediaspark.llm.common import summed

    df = spark.range(0, 10_000, 1, 100).select(F.col("id").cast("double").alias("x"))
    sent = []
    collect = type(df).collect
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(df), "collect", lambda self: sent.append(len(r := collect(self))) or r)
        got = summed(df, lambda batch: np.array([batch.num_rows, batch.column(0).to_numpy().sum()]), 7)
    assert got.tolist() == [10_000, 49_995_000] and sent == [7]
    assert summed(df.limit(0), lambda batch: np.zeros(1)) is None


@pytest.mark.parametrize("share", [0.2, 0.5, 0.85])
def test_prior_from_positives_and_unlabelled_alone(share):
    rng = np.random.default_rng(4)
    n = int(20_000 * share)
    rows = np.concatenate([rng.normal(1.5, 1.0, (n, 3)), rng.normal(-1.5, 1.0, (20_000 - n, 3))])
    positive = rng.normal(1.5, 1.0, (2_000, 3))
    mean, scale = rows.mean(0), rows.std(0)
    w = pu_quality.train_told_apart(local_sums(positive, rows), mean, scale)
    bins = [
        np.histogram(1 / (1 + np.exp(-(pu_quality.standardised(x, mean, scale) @ w[:-1] + w[-1]))), pu_quality.BINS, (0, 1))[0]
        for x in (rows, positive[1::2])
    ]
    assert abs(pu_quality.best_bin(*bins) - share) < 0.06


def test_quality_fit_uses_all_documents(spark, prose):
    """Means, scales, prior and risk are those of every row, also where one id or the null id has very many."""
    texts = prose(400, 5, 40, 120)
    junk = ["#$% " * 40, "a | b | " * 30] * 60
    rows = [(i, t, "a") for i, t in enumerate(texts)] + [(None if k % 2 else 350, t, "a") for k, t in enumerate(junk)]
    docs = documents(spark, rows).repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in range(100)] + [(None, 1), (300, None)], "doc_id long, quality int")
    m = pu_quality.fit(docs, labels)
    x = np.array([pu_quality.features(t.encode()) for _, t, _ in rows])
    assert np.allclose(m.mean, x.mean(0)) and np.allclose(m.scale, np.maximum(x.std(0), 0.02))
    positive = np.array([pu_quality.features(t.encode()) for i, t, _ in rows if i is not None and i < 100])
    want = pu_quality.train_nnpu(local_sums(positive, x), m.prior, m.mean, m.scale)
    assert np.allclose(m.weights, want[:-1], atol=1e-4) and abs(m.bias - want[-1]) < 1e-4
    # No negative label was given.
    assert m.score(np.array(pu_quality.features(texts[0].encode()))) > m.score(np.array(pu_quality.features(junk[0].encode())))


def test_many_rows_of_one_id_do_not_reach_the_driver(spark):
    docs = spark.range(60_000).select(
        F.when(F.col("id") % 2 == 0, F.lit(5)).cast("long").alias("doc_id"), F.concat(F.lit("some words here idiot "), F.col("id")).alias("text")
    )
    labels = spark.createDataFrame([(5, 1, 1), (None, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "777")
    sent = []
    collect = type(docs).collect
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(docs), "collect", lambda self: sent.append(len(r := collect(self))) or r)
        m = pu_quality.fit(docs, labels)
        toxicity.fit(docs, labels)
    assert sent and max(sent) <= 64 and 0 < m.prior < 1
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "777"
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("postings", [bm25.SHARD_POSTINGS, 100])
def test_results_of_home_shards_are_read_without_the_index(spark, prose, postings):
    docs = documents(spark, [(i, t, "a") for i, t in enumerate(prose(40, 8))]).repartition(2)
    found = bm25.top_k(docs, F.col("doc_id") % 10 == 0, k=3, shard_postings=postings)
    assert "data:binary" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 12


def asked_of(counts, queries, n, df):
    """Rows of a bm25.Block: words and weights of texts (Counters) of these numbers."""
    rows = []
    for q in queries:
        words = sorted((bm25.FINGERPRINT(w), f * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))) for w, f in counts[q].items())
        h, x = zip(*words) if words else ((), ())
        rows.append((q, 0, np.array(h, np.uint64).tobytes(), np.array(x, float).tobytes(), 0.0))
    return rows


@pytest.mark.parametrize("product", [0, 2, bm25.PRODUCT, 10**9])
def test_bm25_shards_equal_brute_force_whatever_goes_into_products(monkeypatch, prose, product):
    for name, value in {"PRODUCT": product, "REGION_POSTINGS": 4000, "REGION_DOCS": 150, "QUERIES": 24, "GROUP": 7, "PRODUCTS": 900, "PAIRS": 50}.items():
        monkeypatch.setattr(bm25, name, value)
    texts = [*prose(500, 12), *prose(100, 13, 200, 900), "", "of their own", "of their own"]
    texts[30:60] = [texts[7]] * 30
    counts = [Counter(t.encode().lower().split()) for t in texts]
    df = Counter(w for c in counts for w in c)
    shard = bm25.Shard(sum(c.total() for c in counts) / len(counts))
    for i, t in enumerate(texts):
        shard.add(i, *bm25.counted(t.encode()))
    shard = bm25.Shard.load(bytearray(shard.seal().pack()))
    assert len(shard.edge) > 5
    queries = range(0, len(texts), 4)
    block = bm25.Block(asked_of(counts, queries, len(texts), df))
    want = {q: [(d, -s) for s, d in rows] for q, rows in brute_bm25(texts, queries, 5).items()}
    # Without floors, and with floors that the last of the best just reaches.
    for floors in (block.floor.copy(), np.array([want[q][-1][1] if len(want[q]) == 5 else 0.0 for q in block.q.tolist()])):
        best = {}
        bm25.gather(shard.search(block, floors, 5), best, floors, 5)
        got = {int(block.q[i]): rows for i, rows in best.items()}
        for q in queries:
            assert [d for d, _ in got.get(q, [])] == [d for d, _ in want[q]]
            assert np.allclose([s for _, s in got.get(q, [])], [s for _, s in want[q]], atol=2e-6)
    chosen = block.q % 8 == 0
    assert {int(block.q[i]) for i, _ in shard.search(block, block.floor, 5, chosen)} <= {q for q in queries if q % 8 == 0}


def test_a_packed_index_is_let_go():
    data = bytes(3 * bm25.PART + 5)
    held = sys.getrefcount(data)
    got = [pa.array([part], pa.binary())[0].as_py() for _, part in bm25.pieces(data)]
    assert b"".join(got) == data and sys.getrefcount(data) == held


def test_a_task_hands_on_the_best_of_all_its_shards(spark, prose, monkeypatch):
    staged, found = bm25.staged, []

    def counting(df, name, *args, **kwargs):
        out = staged(df, name, *args, **kwargs)
        if name == "found":
            found.append((out.count(), df.rdd.getNumPartitions()))
        return out

    monkeypatch.setattr(bm25, "staged", counting)
    texts = prose(600, 14)
    docs = documents(spark, [(i, t, "a") for i, t in enumerate(texts)]).repartition(4)
    got = defaultdict(list)
    for r in bm25.top_k(docs, F.col("doc_id") % 20 == 0, k=7, shard_postings=600, query_block=16).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.doc_id)
    assert got == {q: [d for _, d in rows] for q, rows in brute_bm25(texts, range(0, 600, 20), 7).items()}
    assert len(found) == 2 and sum(rows for rows, _ in found) <= 30 * 7 * max(tasks for _, tasks in found)
