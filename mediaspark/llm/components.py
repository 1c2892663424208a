"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, component) for each vertex of `edges` (a long, b long): the smallest vertex that it reaches.

    Alternates two steps until nothing changes: the large star links every larger neighbour of a vertex
    to the smallest one, the small star does so for the smaller neighbours.  Both keep connectivity, and the
    number of rounds grows with the logarithm of the component's size.  A step sums by vertex first and
    joins the sums back, so the neighbours of a hub are never gathered.  Each round is written by
    checkpoint(); no edge or component reaches the driver, which sees a count and a checksum.
    """
    from .common import shared_dir

    shared_dir(edges.sparkSession)
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = e.checkpoint()
    before = _state(e)
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = (
            small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
            .checkpoint()
        )
        after = _state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("v"), F.col("v").alias("component")).union(
        e.select("v", F.col("v").alias("component")).distinct()
    )


def _state(e: DataFrame) -> tuple:
    """Number and checksum of distinct edges; unlike a sum, bits can't overflow, however many edges there are."""
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
