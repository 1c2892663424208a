"""Contiguous shards of near-equal bytes, in DataFrame operations only.

Method: global byte-size prefix sums from per-partition totals, cut at equal targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table
from .prefix import with_global_prefix


def shard_by_bytes(
    docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8
) -> DataFrame:
    """Put every row into one of `shards` contiguous runs of the order (id, checksum, size, row) with near-equal bytes.

    Returns id, size (UTF-8 bytes of the text plus `overhead` a row), text_crc32, shard and slot (gapless
    from 0 in each shard).  A row goes to the shard in which the middle of its bytes lies, so each cut is
    within half a row of its target.  Rows with a null id come first; a null text has no bytes and
    checksum 0; repeated rows are kept, each with its own slot; an empty table gives an empty result.
    Columns other than id and text are neither read nor returned, so their names don't matter; very long texts count whole, and a
    shard that holds one exceeds the others by no more than it.
    """
    rows = staged(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text_col), F.lit(0)) + overhead).cast("long").alias("size"),
            F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "sizes",
    )
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "text_crc32", "size", "_row")]
    placed = with_global_prefix(rows, order, {"_before": F.col("size")}, "_index")
    total = rows.agg(F.sum("size").alias("_total"))
    # floor((before + size / 2) * shards / total) in whole numbers.
    middle = (2 * F.col("_before").cast("decimal(38,0)") + F.col("size")) * shards
    placed = placed.crossJoin(F.broadcast(total)).withColumn(
        "shard", F.least(F.floor(middle / (2 * F.col("_total"))).cast("int"), F.lit(shards - 1))
    )
    starts = placed.groupBy("shard").agg(F.min("_index").alias("_start"))  # `shards` rows
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_index") - F.col("_start")).alias("slot")
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the law `bytes`."""
    return shard_by_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
