"""Global prefix sums from per-partition totals, with no window over the whole table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged


def with_global_prefix(
    df: DataFrame, order: list[Column], sums: Mapping[str, Column], index: str = "row_index"
) -> DataFrame:
    """Add `index`, the 0-based rank of each row in `order`, and for each name in `sums` the sum over all earlier rows.

    The rows are dealt out by ranges of `order` and written once, so each range has a fixed number.  The
    totals of the ranges (one row a range) are summed in a window of their own and sent to all tasks; the
    window over the rows runs within a range.  `order` must be total: give a unique last column, and a key
    that holds many rows is then cut over several ranges.
    """
    for name in (index, *sums):
        if name in df.columns:
            raise ValueError(f"column {name} is taken")
    cells = {f"_v{i}": c.cast("long") for i, c in enumerate(sums.values())}
    ranges = staged(
        df.withColumns({**cells}).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()),
        "ranges",
    )
    totals = ranges.groupBy("_range").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"{c}_t") for c in cells]
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_range",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"{c}_t").over(before), F.lit(0)).alias(f"{c}_0") for c in cells],
    )
    # One row for each range: at most the number of shuffle partitions.
    within = Window.partitionBy("_range").orderBy(*order)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    out = ranges.withColumns(
        {"_r": F.row_number().over(within) - 1}
        | {f"{c}_w": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in cells}
    ).join(F.broadcast(starts), "_range")
    return out.select(
        *df.columns,
        (F.col("_n0") + F.col("_r")).cast("long").alias(index),
        *[(F.col(f"{c}_0") + F.col(f"{c}_w")).cast("long").alias(n) for n, c in zip(sums, cells)],
    )
