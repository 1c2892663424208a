"""A layout of a snapshot's vectors in cells around pivots, so that an exact search reads the cells that may hold a neighbour.

The vectors of the commonest model are dealt to the nearest of at most PIVOTS of them, and lie in files in order of their cells.  A cell
keeps the least and greatest angle to its pivot; by the triangle inequality of angles these bound how near a query any of its vectors
can be.  Vectors of other models, and those without length or of another width, are in cell -1, which is always read.  So are changes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SCHEMAS, Library

#: Pivots at most, and rows of a page.
PIVOTS, PAGE = 256, 256
#: Equalities that a scan is given; more cells are named by ranges.
NAMED = 64
CELLS = "cell int, model string, pivot array<double>, near double, far double, n long"


def write_cells(spark: SparkSession, vectors: DataFrame, path: str) -> bool:
    """Write clip vectors in order of their cells, and beside them, in PATH.cells, the cells; False if there are too few to index."""
    from ..operators.products import _pivots

    top = vectors.groupBy("model").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "model").first()
    count = min(PIVOTS, math.isqrt(top["n"])) if top else 0
    pivots = np.zeros((0, 0))
    if count > 1:
        from ..functions.vectors import l2_normalize

        pivots = _pivots(vectors.filter(F.col("model").eqNullSafe(top["model"])).select(l2_normalize(F.col("embedding")).alias("vector")), count)
    if len(pivots) < 2 or pivots.shape[1] < 2:
        vectors.write.parquet(path)
        return False
    model, width = top["model"], pivots.shape[1]
    columns = [f.name for f in SCHEMAS["clip_embeddings"].fields]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SCHEMAS["clip_embeddings"].fields)
    place, kind = columns.index("embedding"), columns.index("model")

    def run(batches):
        for batch in batches:
            cell, angle = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            vectors = batch.column(place).to_pylist()
            for i, (m, v) in enumerate(zip(batch.column(kind).to_pylist(), vectors)):
                if m == model and v is not None and len(v) == width and None not in v:
                    cell[i] = 0
            at = np.flatnonzero(cell == 0)
            if len(at):
                x = np.array([vectors[i] for i in at.tolist()])
                norm = np.linalg.norm(x, axis=1)
                good = np.isfinite(norm) & (norm > 0)
                cell[at[~good]] = -1
                dots = x[good] / norm[good, None] @ pivots.T
                best = dots.argmax(1)
                cell[at[good]] = best
                angle[at[good]] = np.arccos(np.clip(dots[np.arange(len(best)), best], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=[*columns, "_cell", "_angle"])

    placed = vectors.select(*columns).mapInArrow(run, f"{kinds}, _cell int, _angle double")
    dealt = placed.repartitionByRange("_cell", "_angle", "photo_id").sortWithinPartitions("_cell", "_angle")
    dealt.write.option("parquet.page.row.count.limit", PAGE).parquet(path)
    written = spark.read.schema("_cell int, _angle double").parquet(path).filter("_cell >= 0")
    # At most PIVOTS rows.
    bounds = written.groupBy("_cell").agg(F.min("_angle").alias("near"), F.max("_angle").alias("far"), F.count(F.lit(1)).alias("n")).collect()
    rows = [(r["_cell"], model, pivots[r["_cell"]].tolist(), r["near"], r["far"], r["n"]) for r in bounds]
    spark.createDataFrame(rows, CELLS).coalesce(1).write.parquet(f"{path}.cells")
    return True


def with_cells(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The index of vectors written by write_cells(): cells, and the base rows plus _cell."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SCHEMAS["clip_embeddings"].fields)
    return spark.read.schema(CELLS).parquet(f"{path}.cells"), spark.read.schema(f"{kinds}, _cell int").parquet(path)


def _only(lib: Library, cells: Sequence[int]) -> Library:
    """The library with the vectors of some cells, those of cell -1, and all changes."""
    part = lib.part("clip_embeddings")
    base, named = part.index[1], [-1, *sorted(cells)]
    if len(named) <= NAMED:
        near: Column = reduce(lambda a, b: a | b, [F.col("_cell") == c for c in named])
    else:
        near = F.col("_cell").isin(named)
    rows = base.filter(near).select(*[f.name for f in SCHEMAS["clip_embeddings"].fields])
    return lib.with_tables(clip_embeddings=replace(part, base=rows, index=None, whole=True, saved=0, content=None))


def narrowed(lib: Library, query: Sequence[float], model: str, limit: int, search: Callable[[Library], DataFrame], slack: float = 1e-5) -> Library:
    """The library with those vectors that may be among the `limit` nearest that search(library) finds, all filters included.

    Cells are read in the order of their bounds, twice as many rows each time, until as many are found as wanted; then those that
    could still hold a nearer one than the last of them.
    """
    part = lib.part("clip_embeddings")
    if part is None or part.index is None or limit < 1:
        return lib
    cells = part.index[0].collect()  # at most PIVOTS rows
    q = np.asarray(query, np.float64)
    norm = np.linalg.norm(q)
    if not cells or not np.isfinite(norm) or norm == 0 or len(q) != len(cells[0]["pivot"]):
        return lib
    if model != cells[0]["model"]:
        return _only(lib, [])
    away = np.arccos(np.clip(np.array([c["pivot"] for c in cells]) @ (q / norm), -1, 1))
    near, far = (np.array([c[k] for c in cells]) for k in ("near", "far"))
    bound = np.maximum(0, np.maximum(away - far, near - away)) - slack
    order = np.lexsort((away, bound)).tolist()
    rows, wanted, taken = 0, 4 * limit, 0
    while True:
        while taken < len(order) and rows < wanted:
            rows += cells[order[taken]]["n"]
            taken += 1
        if taken == len(order):
            return lib
        found = search(_only(lib, [cells[i]["cell"] for i in order[:taken]])).agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("least")).first()
        if found["n"] >= limit:
            break
        wanted = 2 * rows + 4 * limit
    reach = math.acos(max(-1.0, min(1.0, found["least"])))
    return _only(lib, [cells[i]["cell"] for k, i in enumerate(order) if k < taken or bound[i] <= reach])
