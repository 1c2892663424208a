"""Dense row numbers in a total order, without a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import _shared_folder


def number_rows(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """`name`: 0, 1, 2, ... in the order of some columns, which should tell all rows apart."""
    _shared_folder(df)
    ranges = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).checkpoint()
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_range").orderBy(*order)
    return (
        ranges.withColumn("_k", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), "_range")
        .withColumn(name, (F.col("_start") + F.col("_k")).cast("long"))
        .drop("_range", "_k", "_start")
    )
