"""A training-corpus pipeline over `documents`: toxicity, quality rules, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs, in their order
and with their names, whatever further columns there are.  A stage works on whole texts however long, takes an empty table to an
empty one, and treats repeated rows as rows of their own (the near-duplicate stage as copies).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaspark.llm import bpe, jaccard, mixing, quality_rules, toxicity
from mediaspark.llm.common import discard, fresh_name, staged, table, temporary, texts_of


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold; the scorer learns from the labels' training rows.

    A null text is scored as an empty one; null ids have no label and are scored like the others.  Without labels of both
    classes among the documents the fixed lexicon decides alone.
    """
    model = toxicity.fit(docs, toxicity.training_rows(table(spark, sf_dir, "labels")))
    # Texts pass once more as a kept column; the score's name is put apart from theirs.
    columns = docs.columns
    name = fresh_name(columns, "toxicity")
    scored = toxicity.score(docs, model, tuple(columns)).toDF(*columns, name)
    return scored.filter(F.col(name) < toxicity.THRESHOLD).select(*columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the current policy rejects.  A null or empty text has too few words and goes."""
    columns = docs.columns
    return quality_rules.kept(docs, quality_rules.CURRENT_POLICY).select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a Jaccard similarity of 0.8 or more.

    Of a group the first row of the smallest id stays, a null id last; texts without words, null ones too, are no group and
    all stay.
    """
    key = fresh_name(docs.columns, "row")
    numbered = staged(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    groups = jaccard.jaccard_components(numbered, percent=80, width=5, row_col=key)
    linked = staged(groups.filter("linked").select("row", "doc_id", "group"), "groups")
    first = linked.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("x"))
    dropped = (
        linked.join(first.select("group", F.col("x.row").alias("first")), "group")
        .filter("row <> first")
        .select(F.col("row").alias(key))
    )
    return numbered.join(dropped, key, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, none or up to three times.

    A null source is a source of its own, a null text has no words; a document of size 0 is taken like its neighbours of that size.
    """
    key = fresh_name(docs.columns, "row")
    numbered = staged(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    rows = numbered.select(
        "doc_id", "source", F.coalesce(mixing.words(), F.lit(0)).cast("long").alias("size"), F.col(key).alias("row")
    )
    taken = mixing.copies_of(staged(rows, "mix")).filter("copies > 0")
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    emitted = taken.select(F.col("row").alias(key), F.col("copies")).select(key, times.alias(fresh_name([*docs.columns, key], "copy")))
    return numbered.join(emitted, key).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with a check that they decode to its text; a null text has no tokens and counts as empty."""
    return bpe.encode(
        docs,
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        keep=("doc_id", "lang", "source"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_tokens),
]
#: Neither the toxicity scorer nor the tokenizer can be put in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next; what a stage needed goes once it is written."""
    docs = texts_of(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before = docs
        with temporary() as tables:
            docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            tables.pop()  # the stage's result, written last, stays
        if i:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
