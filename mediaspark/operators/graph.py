"""Connected components of an edge table."""

from __future__ import annotations

import tempfile
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _shared_folder(df: DataFrame) -> None:
    """Checkpoints go to the session's spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """df read from a checkpoint: a short plan, and values that no second run can change."""
    _shared_folder(df)
    return df.checkpoint()


def settled(library, *names: str):
    """The library with some tables cut, so that plans don't grow from step to step.

    Of a table that a snapshot holds only the changes are written, and they stay changes.
    """
    out = {}
    for n in names:
        part = library.part(n)
        if library.source is None or part.whole:
            out[n] = replace(part, base=cut(library[n]), changes=(), content=None)
        else:
            out[n] = replace(part, changes=tuple(c if c.settled else c.with_rows(cut(c.rows)) for c in part.changes), content=None)
    return library.with_tables(**out)


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, component) for each vertex of edges (a long, b long): the least id in reach.

    Each round hands every vertex the least label among its neighbours and then the label of that label, so
    distances shrink by half; it ends when no label changes.  Rounds are checkpointed, so a plan stays short and a
    lost executor repeats one round.
    """
    _shared_folder(edges)
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")).checkpoint()
    for _ in range(rounds):
        near = (
            both.join(labels.select(F.col("id").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("label").alias("near"))
        )
        step = labels.join(near, "id").select("id", F.least("label", "near").alias("label"))
        far = step.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = step.join(far, "label", "left").select("id", F.least("label", F.coalesce("far", "label")).alias("new"))
        joined = labels.join(new, "id").select("id", "label", "new").checkpoint()
        changed = joined.filter("new <> label").limit(1).count()
        labels = joined.select("id", F.col("new").alias("label"))
        if not changed:
            return labels.select("id", F.col("label").alias("component"))
    raise RuntimeError("components did not settle")
