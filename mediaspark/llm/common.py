"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import ctypes
import gc
import math
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a longest run of bytes that are none of space, \t, \n, \v, \f, \r.  bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder; any other session is refused, as the
    executors of a cluster would each write to their own disk.
    """
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    set_already = sc._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return conf or set_already.get()
    if not conf:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(conf)
    return conf


def staged(df: DataFrame, name: str, by: str | None = None, rows: int | None = None) -> DataFrame:
    """Write df as Parquet, in a folder for each value of column `by` if given, in the shared folder and read it back.

    Batches hold BATCH_ROWS rows, or `rows` on their way from a file as well, for tables of large cells.  This cuts the lineage, so a lost executor costs no more than the stages after the table, and it
    freezes values such as row ids that a second evaluation could draw differently.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"
    with small_batches(spark, rows):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    if _scopes:
        _scopes[-1].append(out)
    return out


_scopes: list[list[DataFrame]] = []


@contextmanager
def temporary():
    """Delete all tables staged within, at the end: for a caller who has written what came from them by then.

    Operators whose results are evaluated later can't delete what these still read.  Gives the list of tables; one taken out stays.
    """
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        discard(*_scopes.pop())


def discard(*tables: DataFrame) -> None:
    """Delete staged() tables that nothing reads any more: all that came from them is staged itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._staged)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh_name(columns: list[str], name: str) -> str:
    """`name`, with underscores before it until no column is called so, letter case aside."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def kept_names(keep: tuple[str, ...], outputs: tuple[str, ...]) -> list[str]:
    """Names of kept columns beside an operator's own outputs: one that is called like an output gets underscores before it."""
    names: list[str] = []
    for c in keep:
        names.append(fresh_name([*outputs, *names], c))
    return names


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table of texts under which it is dealt over all cores.
SMALL = 64 << 20


def texts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; a file of a row group or two, which no split can part, is dealt over all cores first."""
    docs = table(spark, sf_dir, "documents")
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return docs.repartition(spark.sparkContext.defaultParallelism) if size < SMALL else docs


def remainder(column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo `modulus`; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def utf8(column: str) -> Column:
    """The text's bytes, an empty string for null."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


#: Bytes of counts that a task gathers before it hands them on.
COUNTED = 64 << 20


class Memo(dict):
    """What a Python worker remembers of words or pieces: of(key), computed once and kept until it takes `limit` bytes.

    Call trim() between texts; so a worker holds at most `limit` bytes and what one text adds, however long its words.
    """

    def __init__(self, of: Callable, limit: int = 64 << 20):
        super().__init__()
        self.of, self.limit, self.used = of, limit, 0

    def __missing__(self, key):
        value = self[key] = self.of(key)
        self.used += sys.getsizeof(key) + sys.getsizeof(value) + 100
        return value

    def trim(self) -> None:
        if self.used > self.limit:
            self.clear()
            self.used = 0


def release_memory() -> None:
    """Give back what earlier tasks of this Python worker have left: their functions and broadcast values, and freed memory.

    A task's functions refer to each other, so only the collector frees them and what they hold.  glibc raises the size from which
    freed arrays go back to the system up to 32 MB as it meets such arrays, and keeps smaller ones in its heap, in pieces; here it
    stays at 4 MB.  Elsewhere than with glibc that part does nothing.
    """
    gc.collect()
    if not gc.get_freeze_count():
        gc.freeze()  # modules; collecting again takes little time
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        m_trim_threshold, m_mmap_threshold = -1, -3
        libc.mallopt(m_mmap_threshold, 4 << 20)
        libc.mallopt(m_trim_threshold, 8 << 20)
        libc.malloc_trim(0)


def in_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow; each task first gives back what earlier ones of its worker left, so that a worker's memory is that of one task."""

    def run(batches):
        release_memory()
        yield from f(batches)

    return df.mapInArrow(run, schema)


def spread_join(rows: DataFrame, per_key: DataFrame, keys: list[str], salt_by: str, salts: int) -> DataFrame:
    """rows joined with per_key (one row a key), without gathering a key's rows in one task.

    The rows of a key are dealt by a hash of `salt_by` over `salts` parts, and per_key is copied once for each part that a key has.
    With the root of the greatest number of rows as `salts`, neither side of either join holds more than about that root of a key.
    """
    name = fresh_name([*rows.columns, *per_key.columns], "salt")
    dealt = rows.withColumn(name, F.pmod(F.xxhash64(salt_by), F.lit(max(1, salts))))
    parts = dealt.select(*keys, name).distinct().join(per_key, keys)
    return dealt.join(parts, [*keys, name]).drop(name)


def root_of(df: DataFrame) -> int:
    """The square root of a table's number of rows, rounded up."""
    return math.isqrt(df.count()) + 1


#: Rows of texts that a worker takes from an Arrow batch at once.
BATCH_ROWS = 1_000


@contextmanager
def small_batches(spark: SparkSession, rows: int | None = None):
    """Arrow batches of BATCH_ROWS rows for the actions within; the session's own setting comes back after them.

    With `rows` Arrow batches and those read from Parquet are of so many.  A batch stands in memory several times, on
    both sides.  Spark bounds it by bytes too, so results that a caller evaluates later, at the caller's setting, are bounded as well.
    """
    arrow, reader = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    wanted = {arrow: rows or BATCH_ROWS} | ({reader: rows} if rows else {})
    now = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        if not 0 < int(now[name]) <= value:
            spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in now.items():
            spark.conf.set(name, value)


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of BATCH_ROWS rows at most."""
    for batch in batches:
        for lo in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(lo, BATCH_ROWS)


def map_rows(
    df: DataFrame,
    make: Callable[[], Callable[[tuple], tuple]],
    schema: str,
) -> DataFrame:
    """One output row per input row through mapInArrow; make() runs once in each task and returns the row function."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in parts_of(batches):
            cols = [c.to_pylist() for c in batch.columns]
            out = [f(row) for row in zip(*cols)]
            if out:
                yield _record_batch(out, arrow)

    return in_arrow(df, run, schema)


def map_chunks(
    df: DataFrame,
    make: Callable[[], Callable[[list[tuple]], list[tuple]]],
    schema: str,
    weigh: Callable[[tuple], int],
    most: int = 1 << 20,
) -> DataFrame:
    """As map_rows, with a function from a list of rows to a list of rows; a list ends once its weights reach `most`."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in parts_of(batches):
            rows, weight = [], 0
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                rows.append(row)
                weight += weigh(row)
                if weight >= most:
                    yield _record_batch(f(rows), arrow)
                    rows, weight = [], 0
            if rows:
                yield _record_batch(f(rows), arrow)

    return in_arrow(df, run, schema)


def _record_batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [[] for _ in arrow]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, arrow)], schema=arrow)


#: Vectors that summed() hands to the driver, at most.
SUMS = 64


def summed(df: DataFrame, f: Callable[[pa.RecordBatch], np.ndarray], most: int = SUMS) -> np.ndarray | None:
    """The sum over all batches of what f gives, None without rows.

    A task makes one vector, whatever its rows.  Where there are more than `most` tasks, their vectors are added in that many
    groups first, so the driver gets `most` vectors whatever the number of tasks.  df is a table that is read, without shuffles.
    Vectors are added in the order of the tasks' numbers, so the order of arrival doesn't matter.
    """
    ddl = "part int, s binary"
    schema = arrow_schema(ddl)

    def one(part: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.astype(float).tobytes()], pa.binary())], schema=schema)

    def run(batches):
        total = None
        for batch in parts_of(batches):
            part = f(batch)
            total = part if total is None else total + part
        if total is not None:
            yield one(TaskContext.get().partitionId(), total)

    def add(batches):
        rows = [r for batch in batches for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for part, vector in rows:
            groups.setdefault(part % most, []).append((part, vector))
        for group, vectors in groups.items():
            yield one(group, _in_order(vectors))

    sums = in_arrow(df, run, ddl)
    if df.rdd.getNumPartitions() > most:
        sums = in_arrow(sums.repartition(most, F.col("part") % most), add, ddl)
    rows = sums.collect()
    return _in_order([(r["part"], bytes(r["s"])) for r in rows]) if rows else None


def _in_order(vectors: list[tuple[int, bytes]]) -> np.ndarray:
    return np.sum([np.frombuffer(v) for _, v in sorted(vectors)], axis=0)


def minimise(f: Callable, w: np.ndarray, rounds: int = 40, tolerance: float = 1e-6) -> np.ndarray:
    """The minimum of a convex function by limited-memory BFGS: f(w) gives (value, gradient).

    Each f is a pass over the data; a step that Armijo's rule refuses is halved.
    """
    value, g = f(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, kept = -g, []
        for s, y in reversed(steps):
            a = s @ d / (y @ s)
            d = d - a * y
            kept.append(a)
        if steps:
            s, y = steps[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(kept)):
            d = d + s * (a - y @ d / (y @ s))
        slope = float(g @ d)
        if slope >= 0 or not np.isfinite(slope):
            break
        step = 1.0 if steps else min(1.0, 1.0 / max(1e-12, np.abs(g).sum()))
        for _ in range(12):
            new = w + step * d
            then, h = f(new)
            if then <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        if (new - w) @ (h - g) > 1e-14:
            steps = [*steps, (new - w, h - g)][-10:]
        gain, w, g, value = value - then, new, h, then
        if gain <= tolerance * max(1e-3, abs(value)):
            break
    return w


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))
