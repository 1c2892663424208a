"""Products of vectors near each other: blocks gathered around pivots, alone or multiplied in tiles where the angles allow a hit."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut

#: Vectors in a block, and pivots that blocks gather around, at most.
BLOCK, PIVOTS = 2_048, 256
#: Vectors that drawn() sends to all tasks, at most.
DRAWN = 4_096
#: Bytes of blocks that a task holds while it streams the other side of its tile.
HELD = 256 << 20

#: product(ids, labels, vectors, ids, labels, vectors, same) of two blocks: a frame, or None; same: whether they are one block.
Product = Callable[..., pd.DataFrame | None]
_CELLS = "pivot int, angle double, ids array<long>, labels array<long>, flat array<double>"


def near_products(left: DataFrame, right: DataFrame | None, least: float, product: Product, schema: str) -> DataFrame:
    """What `product` gives for all pairs of blocks that may hold a cosine of `least` or more.

    left and right: id long, label long, vector array<double> of length 1 (or 0).  Without `right` the pairs are those of
    left's blocks, each pair once and each block with itself.

    Vectors are assigned to the nearest of at most PIVOTS vectors drawn from right, and a block holds up to BLOCK of one
    pivot with the greatest angle to it.  By the triangle inequality of angles two blocks are out of reach if their pivots'
    angle less both greatest angles exceeds that of `least`; such pairs are never multiplied.  All others are, so no
    hit is lost.  Vectors without neighbourhoods, such as random ones, are all in reach of each other.

    Blocks meet in tiles of a grid.  In order of pivot and angle, the blocks of each side are cut into as many tile rows (or columns)
    as the root of their number, or more where a task couldn't hold a row.  A block goes once to each tile of its row that
    holds a block in reach, and a task keeps the row's blocks and streams the column's.  So n vectors are shuffled as n to the
    power of 1.5 at most, and by pruning less, until rows are limited by memory.  Up to BLOCK vectors on the left go to all tasks
    instead, and those on the right stay where they are.
    """
    alone = right is None
    lefts = left.count()
    rights = lefts if alone or not lefts else right.count()
    if not lefts or not rights:
        return left.sparkSession.createDataFrame([], schema)
    size = max(lefts, rights)
    limit = float(np.arccos(np.clip(least, -1.0, 1.0))) + 1e-9
    if is_few(size):
        return _few(left, right, product, schema)
    if not alone and lefts <= BLOCK:
        return _beside(left, right, product, schema)
    pivots = _pivots(left if right is None else right, min(PIVOTS, size // BLOCK))
    a = _Side(_blocks(left, pivots))
    b = a if right is None else _Side(_blocks(right, pivots))
    apart = np.arccos(np.clip(pivots @ pivots.T, -1, 1)) if len(pivots) > 1 else np.zeros((1, 1))
    width = a.width()
    a.cut_into(max(math.isqrt(max(0, a.n - 1)) + 1, -(-a.n * BLOCK * width * 8 // HELD)))
    if b is not a:
        b.cut_into(math.isqrt(max(0, b.n - 1)) + 1)
    columns = b.tiles
    rows = a.reaching(b, apart, limit, 0, alone)
    rows = rows.unionByName(b.reaching(a, apart, limit, 1, alone))
    dealt = rows.withColumn("_to", F.col("row") * columns + F.col("column")).repartitionById(max(1, a.tiles * columns), "_to")

    def run(batches):
        tile, held = None, []
        for side, to, n, pivot, angle, x in _read(batches):
            if to != tile:
                tile, held = to, []
            if side == 0:
                held.append((n, pivot, angle, x))
                continue
            for m, p, far, y in held:
                if apart[p, pivot] - far - angle <= limit and (not alone or m <= n):
                    out = product(*y, *x, alone and m == n)
                    if out is not None and len(out):
                        yield out

    run_on = dealt.sortWithinPartitions("_to", "side").select("side", "_to", "n", "pivot", "angle", "ids", "labels", "flat")
    kind = [f.split()[0] for f in schema.split(", ")]
    arrow = _arrow(schema)
    return run_on.mapInArrow(lambda batches: (pa.RecordBatch.from_pandas(out[kind], arrow, preserve_index=False) for out in run(batches)), schema)


def is_few(size: int) -> bool:
    """Whether so many vectors are one task's work."""
    return size < 2 * BLOCK


def each_block(rows: DataFrame, size: int, product: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
    """What product(ids, labels, vectors) gives for each block of rows, of which there are `size`: as much work as rows."""
    blocks = _blocks(rows, _pivots(rows, min(PIVOTS, size // BLOCK))).withColumn("side", F.lit(0))
    kind = [f.split()[0] for f in schema.split(", ")]
    arrow = _arrow(schema)
    zero = F.lit(0).cast("long")

    def run(batches):
        for *_, x in _read(batches):
            yield pa.RecordBatch.from_pandas(product(*x)[kind], arrow, preserve_index=False)

    return blocks.select("side", zero.alias("_to"), zero.alias("n"), "pivot", "angle", "ids", "labels", "flat").mapInArrow(run, schema)


def drawn(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors of at most DRAWN rows that a hash of the id draws."""
    few = rows.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(DRAWN).collect()
    return np.array([r["id"] for r in few], dtype=np.int64), np.array([r["vector"] for r in few], dtype=np.float64)


def _beside(left: DataFrame, right: DataFrame, product: Product, schema: str) -> DataFrame:
    """The products of at most BLOCK vectors, which all tasks get, with all others."""
    few = left.select("id", "label", "vector").collect()
    ids, labels = (np.array([r[c] for r in few], dtype=np.int64) for c in ("id", "label"))
    vectors = np.array([r["vector"] for r in few], dtype=np.float64)
    kind = [f.split()[0] for f in schema.split(", ")]
    arrow = _arrow(schema)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                i, label, v = (c.to_numpy(zero_copy_only=False) if k < 2 else c for k, c in enumerate(batch.slice(lo, BLOCK).columns))
                out = product(ids, labels, vectors, i, label, v.flatten().to_numpy(zero_copy_only=False).reshape(len(i), -1), False)
                if out is not None and len(out):
                    yield pa.RecordBatch.from_pandas(out[kind], arrow, preserve_index=False)

    return right.select("id", "label", "vector").mapInArrow(run, schema)


def _few(left: DataFrame, right: DataFrame | None, product: Product, schema: str) -> DataFrame:
    """The products of so few vectors that one task multiplies all."""
    one, alone = np.zeros((1, 1)), right is None
    rows = _blocks(left, one, few=True).withColumn("side", F.lit(0))
    if right is not None:
        rows = rows.unionByName(_blocks(right, one, few=True).withColumn("side", F.lit(1)))

    def run(batches):
        sides: tuple[list, list] = ([], [])
        for side, _, __, ___, ____, x in _read(batches):
            sides[side].append(x)
        for i, x in enumerate(sides[0]):
            for j, y in enumerate(sides[0][i:] if alone else sides[1]):
                out = product(*x, *y, alone and j == 0)
                if out is not None and len(out):
                    yield out

    kind = [f.split()[0] for f in schema.split(", ")]
    arrow = _arrow(schema)
    zero = F.lit(0).cast("long")
    one_task = rows.repartition(1).select("side", zero.alias("_to"), zero.alias("n"), "pivot", "angle", "ids", "labels", "flat")
    return one_task.mapInArrow(lambda batches: (pa.RecordBatch.from_pandas(out[kind], arrow, preserve_index=False) for out in run(batches)), schema)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """side, tile, number, pivot, angle and (ids, labels, vectors) of each block; a column's values are views of the batch."""
    for batch in batches:
        heads = zip(*[c.to_pylist() for c in batch.columns[:5]])
        for k, head in enumerate(heads):
            ids, labels, flat = (batch.column(i)[k].values.to_numpy(zero_copy_only=False) for i in (5, 6, 7))
            yield *head, (ids, labels, flat.reshape(len(ids), -1))


class _Side:
    """The blocks of one side, numbered from 0 in order of pivot and angle, and their tiles."""

    def __init__(self, blocks: DataFrame):
        part, place = F.shiftright("m", 33), F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
        blocks = cut(blocks.withColumn("m", F.monotonically_increasing_id()))
        # One row for each task that made blocks.
        counts = sorted((r["part"], r["k"]) for r in blocks.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("k")).collect())
        self.n = sum(k for _, k in counts)
        starts, at = [], 0
        for p, k in counts:
            starts.append((p, at))
            at += k
        table = blocks.sparkSession.createDataFrame(starts, "part long, start long")
        self.blocks = blocks.withColumn("part", part.cast("long")).join(F.broadcast(table), "part").withColumn("n", F.col("start") + place).drop("part", "start", "m")
        self.bounds: list[tuple[int, int, float]] = []

    def width(self) -> int:
        r = self.blocks.select((F.size("flat") / F.size("ids")).alias("d")).first()
        return int(r["d"]) if r else 1

    def cut_into(self, tiles: int) -> None:
        """Tiles of near-equal numbers of blocks, and the greatest angle of each pivot in each tile: as many rows as tiles and pivots, about."""
        self.per = max(1, -(-self.n // max(1, tiles)))
        self.tiles = max(1, -(-self.n // self.per))
        tile = F.floor(F.col("n") / self.per).cast("int")
        self.blocks = self.blocks.withColumn("tile", tile)
        rows = self.blocks.groupBy("tile", "pivot").agg(F.max("angle").alias("far")).collect()
        self.bounds = [(r["tile"], r["pivot"], r["far"]) for r in rows]

    def reaching(self, other: _Side, apart: np.ndarray, limit: float, side: int, alone: bool) -> DataFrame:
        """The blocks once for each tile where they may meet one of the other side: side, row, column and the block's columns."""
        tiles, pivots, far = (np.array(x) for x in zip(*other.bounds)) if other.bounds else (np.zeros(0, int),) * 3
        schema = _arrow(f"n long, tile int, {_CELLS}, meets array<int>")

        def run(batches):
            for batch in batches:
                own = batch.column(1).to_pylist()
                meets = []
                for t, p, angle in zip(own, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    near = tiles[apart[p, pivots] - angle - far <= limit]
                    if alone:
                        near = near[near >= t] if side == 0 else near[near <= t]
                    meets.append(np.unique(near).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(meets, pa.list_(pa.int32()))], schema=schema)

        cells = self.blocks.select("n", "tile", "pivot", "angle", "ids", "labels", "flat")
        met = cells.mapInArrow(run, f"n long, tile int, {_CELLS}, meets array<int>").withColumn("meets", F.explode("meets"))
        row, column = ("tile", "meets") if side == 0 else ("meets", "tile")
        return met.select(F.lit(side).alias("side"), F.col(row).alias("row"), F.col(column).alias("column"), "n", "pivot", "angle", "ids", "labels", "flat")


def _pivots(vectors: DataFrame, n: int) -> np.ndarray:
    """Up to n vectors of length 1, each as far from those before it as any of 4 n that a hash draws; one that stands for no choice if n is under 2."""
    if n < 2:
        return np.zeros((1, 1))
    # At most 4 PIVOTS rows.
    rows = vectors.select("vector").filter(F.size("vector") > 0).distinct().orderBy(F.xxhash64("vector")).limit(4 * n).collect()
    v = np.array([r["vector"] for r in rows], dtype=np.float64)
    v = v[np.linalg.norm(v, axis=1) > 0.5] if len(v) else v
    if len(v) < 2:
        return np.zeros((1, 1))
    chosen, nearest = [], np.full(len(v), -2.0)
    for _ in range(min(n, len(v))):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, v @ v[chosen[-1]])
    return v[chosen]


def _blocks(rows: DataFrame, pivots: np.ndarray, few: bool = False) -> DataFrame:
    """pivot, angle (greatest angle to it), ids, labels, flat (vectors end to end) of blocks; `few` leaves rows where they are."""

    def stacked(column) -> np.ndarray:
        return np.stack([np.asarray(x, dtype=np.float64) for x in column])

    def block(part: pd.DataFrame, pivot: int, angle: float) -> pd.DataFrame:
        flat = np.concatenate([np.asarray(x, dtype=np.float64) for x in part["vector"]])
        return pd.DataFrame({"pivot": [pivot], "angle": [angle], "ids": [part["id"].to_numpy()], "labels": [part["label"].to_numpy()], "flat": [flat]})

    def gather(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), BLOCK):
                yield block(pdf.iloc[lo : lo + BLOCK], 0, float(np.pi))

    rows = rows.select("id", "label", "vector")
    if few:
        return rows.mapInPandas(gather, _CELLS)

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                v = stacked(pdf["vector"])
                if len(pivots) < 2:
                    yield pdf.assign(pivot=np.int32(0), angle=float(np.pi))
                    continue
                dots = v @ pivots.T
                best = dots.argmax(1)
                angle = np.arccos(np.clip(dots[np.arange(len(v)), best], -1, 1)) + 1e-7
                # A vector without length has no angle and may not be left out.
                angle[np.linalg.norm(v, axis=1) < 0.5] = np.pi
                yield pdf.assign(pivot=best.astype(np.int32), angle=angle)

    def gather_by_pivot(batches):
        waiting: list[pd.DataFrame] = []
        n, now = 0, None
        for pdf in batches:
            for pivot, part in pdf.groupby("pivot", sort=False):
                while len(part):
                    if waiting and (pivot != now or n == BLOCK):
                        whole = pd.concat(waiting)
                        yield block(whole, now, float(whole["angle"].max()))
                        waiting, n = [], 0
                    now = int(pivot)
                    waiting.append(part.iloc[: BLOCK - n])
                    part = part.iloc[BLOCK - n :]
                    n += len(waiting[-1])
        if waiting:
            whole = pd.concat(waiting)
            yield block(whole, now, float(whole["angle"].max()))

    assigned = cut(rows.mapInPandas(assign, "id long, label long, vector array<double>, pivot int, angle double"))
    # By ranges of pivot and id, so a pivot that holds very many vectors is cut over several tasks.
    dealt = assigned.repartitionByRange("pivot", "angle", "id").sortWithinPartitions("pivot", "angle")
    return dealt.mapInPandas(gather_by_pivot, _CELLS)
