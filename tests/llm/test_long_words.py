"""Words of a megabyte, and many long ones: results are right and worker memories stay bounded by bytes."""

import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from llm_cases import documents
from pyspark.sql import functions as F

from mediaspark.llm import bm25, bpe, jaccard, ppm, pu_quality, quality_rules, token_counts, toxicity
from mediaspark.llm.common import Memo

MB = 1 << 20
ROWS = [(1, "a" * MB, "a"), (2, "a" * MB, "a"), (3, "ab" * (MB // 2) + " idiot word", "b"), (4, "一" * (MB // 4), "b"), (5, "idiot word", "b")]


@pytest.fixture(scope="module")
def long_words(spark):
    return documents(spark, ROWS).repartition(2).cache()


def test_memo_is_bounded_by_bytes():
    memo = Memo(len, limit=1 << 20)
    for i in range(5_000):
        memo.trim()
        assert memo[b"x" * 4096 + b"%d" % i] > 4096
        assert memo.used < (1 << 20) + 10_000 and len(memo) < 300


def test_ops_take_long_words(spark, long_words):
    groups = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(long_words).collect()}
    assert groups == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 4), 5: (1, 5)}
    counts = {r.doc_id: r for r in token_counts.count_tokens(long_words, [("▁", -1.0), ("a", -2.0), ("aaaa", -3.0), ("b", -2.0), ("▁word", -1.0)]).collect()}
    # One unknown run a text of other characters; SPACE and a's in fours.
    assert counts[1].n_tokens == 1 + MB // 4 and counts[1].n_bytes == MB and counts[4].n_tokens == 2
    labels = spark.createDataFrame([(3, 1), (5, 1), (1, 0), (4, 0)], "doc_id long, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.score(long_words, toxicity.fit(long_words, labels)).collect()}
    assert scores[3] == pytest.approx(scores[5]) and scores[5] > scores[1]
    assert {r.doc_id for r in pu_quality.score(long_words, pu_quality.fit(long_words, labels.withColumnRenamed("toxic", "quality"))).collect()} == set(range(1, 6))
    rules = {r.doc_id: r for r in quality_rules.ledger(long_words).collect()}
    assert rules[1].word_chars == MB and rules[4].word_chars == MB // 4
    ppm_rows = {r.doc_id: r for r in ppm.score(long_words, F.col("doc_id") != 2).collect()}
    assert ppm_rows[1].score == pytest.approx(ppm_rows[2].score) and ppm_rows[2].n_known == 2
    top = {(r.query_id, r.rank): r.doc_id for r in bm25.top_k(long_words, F.lit(True), k=2).collect()}
    assert (top[1, 1], top[1, 2], top[5, 1]) == (1, 2, 5) and top[3, 2] == 5


def test_bpe_takes_long_words(spark, long_words):
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(f.read()), special_tokens={})
    docs = long_words.filter("doc_id in (2, 3, 5)").withColumn("text", F.substring("text", 1, 200_000))
    got = {r.doc_id: r for r in bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, digests=True).collect()}
    for i, t, _ in ROWS:
        if i in got:
            ids = enc.encode_ordinary(t[:200_000])
            assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_names_of_outputs_may_be_kept(spark, edge):
    """A kept column that is called like an output has an underscore before its name."""
    keep = ("doc_id", "score", "_score")
    docs = edge.withColumnRenamed("k0", "_score")
    model = toxicity.ToxicityModel(["widiot"], [4.0], -4.0, None)
    assert toxicity.score(docs, model, keep).columns == ["doc_id", "_score", "__score", "score"]
    assert ppm.score(docs, F.lit(True), keep).columns[:3] == ["doc_id", "_score", "__score"]
    rules = quality_rules.ledger(docs.withColumnRenamed("size", "N_words"), ("doc_id", "N_words"))
    assert rules.columns[:3] == ["doc_id", "_N_words", "n_words"] and rules.filter("_N_words <> 8").count() == 0
    assert token_counts.count_tokens(docs, [("▁", -1.0), ("a", -2.0)], ("doc_id", "n_chars")).columns == ["doc_id", "_n_chars", "n_chars", "n_bytes", "n_tokens"]
    with_ids = docs.withColumnRenamed("size", "ids")
    assert bpe.encode(with_ids, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, ("doc_id", "ids")).columns == ["doc_id", "_ids", "n_tokens", "ids", "intact"]
