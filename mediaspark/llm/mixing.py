"""Mixing sources to target weights, in DataFrame operations only.

Method: systematic sampling.  The expected copies of the documents of a source are prefix-summed, one
random offset is added for the source, and a document is emitted once for each whole number that its
interval crosses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, staged, table
from .prefix import with_global_prefix


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, share_percent: int = 100
) -> DataFrame:
    """Target size of each source: (source, source_size) in, source_size and target added.

    Sources in code point order, null last, weigh `weights` in turn and share `share_percent` of all
    sizes; a target stops at `cap` times its source's size, and the excess is shared again by weight until
    none is above.  With the sources in the order of cap / weight, those up to a point are at their cap and
    the others get the same amount per unit of weight: two prefix sums over the sources find that point,
    in whole numbers.  An empty source has target 0.
    """
    ranked = with_global_prefix(sizes, [F.col("source").asc_nulls_last()], {}, "_rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    weighed = ranked.withColumns({"_w": weight, "_cap": F.col("source_size") * cap})
    totals = weighed.agg(
        F.floor(F.sum("source_size") * share_percent / 100).cast("long").alias("_all"), F.sum("_w").alias("_weights")
    )
    # Sources whose cap binds first come first; exact order of cap / weight by a common multiple.
    multiple = 1
    for w in set(weights):
        multiple *= w
    step = (F.col("_cap") * F.expr(f"{multiple} div _w")).asc()
    levels = with_global_prefix(
        weighed, [step, F.col("_rank").asc()], {"_caps": F.col("_cap"), "_ws": F.col("_w")}, "_level"
    ).crossJoin(F.broadcast(totals))
    rate = (F.col("_all") - F.col("_caps")) / (F.col("_weights") - F.col("_ws"))
    # The first source that its share does not fill sets the rate; if all are full the rate is null.
    free = levels.filter(rate * F.col("_w") <= F.col("_cap")).agg(F.min_by(rate, "_level").alias("_rate"))
    return weighed.crossJoin(F.broadcast(free)).select(
        "source",
        "source_size",
        F.least(F.col("_cap").cast("double"), F.col("_rate") * F.col("_w")).alias("target"),
    )


def mix(
    docs: DataFrame,
    size,
    source_col: str = "source",
    id_col: str = "doc_id",
    weights: tuple[int, ...] = (5, 2, 1),
    cap: int = 3,
    share_percent: int = 100,
    seed: str = "mix",
) -> DataFrame:
    """How many copies of each document the mix takes: doc_id, source, size, source_size, target, copies, row.

    Each document of a source expects target / source_size copies.  Within a source the documents stand
    in the order of size, so a run of neighbours with about one size shares each draw, and the words taken
    differ from the target by no more than the source's longest document.  The offset of a source is a hash
    of its name and `seed`, so reruns agree.  A null source is a source of its own, a null size counts as 0,
    repeated rows are rows like any other, an empty table gives an empty result.  `row` numbers the rows of
    `docs` in their scan order; no source is ever gathered in one task, however many rows it holds.  Sizes of very long
    texts count whole; columns other than id, source and what `size` reads are not read.
    """
    rows = staged(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(size, F.lit(0)).cast("long").alias("size"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "mix",
    )
    return copies_of(rows, weights, cap, share_percent, seed)


def copies_of(
    rows: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    cap: int = 3,
    share_percent: int = 100,
    seed: str = "mix",
) -> DataFrame:
    """mix() of rows that have doc_id, source, size and a unique row already."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, cap, share_percent)
    order = [
        F.col("source").asc_nulls_last(),
        F.col("size").asc(),
        F.col("doc_id").asc_nulls_first(),
        F.col("row").asc(),
    ]
    placed = with_global_prefix(rows, order, {}, "_index")
    first = placed.groupBy("source").agg(F.min("_index").alias("_first"))
    sources = targets.join(first.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    name = F.concat_ws(":", F.lit(seed), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    offset = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    sources = sources.select(
        F.col("source").alias("_s"),
        "source_size",
        "target",
        "_first",
        offset.alias("_u"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("_rate"),
    )
    rank = F.col("_index") - F.col("_first")
    crossed = F.floor((rank + 1) * F.col("_rate") + F.col("_u")) - F.floor(rank * F.col("_rate") + F.col("_u"))
    return placed.join(sources, F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.least(crossed, F.lit(cap)).cast("long").alias("copies"),
        "row",
    )


def words(text_col: str = "text"):
    """Number of words in a text."""
    return F.regexp_count(F.col(text_col), F.lit(WORD))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    return mix(table(spark, sf_dir, "documents"), words()).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "copies",
    )


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, row_number() OVER () AS row,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w,
             3 * source_size AS cap,
             row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s),
p AS (SELECT *, row_number() OVER o AS level,
             coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS caps,
             coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ws,
             (SELECT sum(source_size) FROM s)::BIGINT AS whole, (SELECT sum(w) FROM w)::BIGINT AS weights
      FROM w WINDOW o AS (ORDER BY cap * (10 // w), rk)),
r AS (SELECT (whole - caps)::DOUBLE / (weights - ws)::DOUBLE AS rate, level FROM p
      WHERE (whole - caps)::DOUBLE / (weights - ws)::DOUBLE * w <= cap ORDER BY level LIMIT 1),
t AS (SELECT source, source_size, least(cap::DOUBLE, (SELECT rate FROM r) * w) AS target,
             CASE WHEN source_size > 0 THEN least(cap::DOUBLE, (SELECT rate FROM r) * w) / source_size ELSE 0 END AS per,
             ('0x' || substr(md5('mix:' || coalesce('s' || source, 'n')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
      FROM w),
k AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST, row) - 1 AS rank FROM d),
c AS (SELECT k.doc_id, k.size, t.source_size, t.target,
             least(floor((rank + 1) * per + u) - floor(rank * per + u), 3)::BIGINT AS copies
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""
