"""Library state on disk: each version is a manifest that names files of base rows and of changes, table by table.

A save writes what has changed since the version it came from: nothing for a table that is as it was, a small file of keyed changes for
one that mutations touched, all rows for one that was replaced.  The manifest carries over the files of the rest, and reading merges
the changes.  After FOLD changes a table is written whole again.  Whole photos have a trigram index
beside them (textindex), and whole clip vectors lie in cells around pivots (vectorindex).

A reader never sees a half-written state, a lost writer leaves the old one in place, and a path that is being read
is never overwritten.  Each version has a pointer file of its own, which names the folder and is never replaced; it is written
through Hadoop's file systems, so a snapshot may lie in any store that Spark reaches.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import SCHEMAS, Library, Part
from . import textindex, vectorindex
from .deltas import Change

#: Changes of a table that a manifest names, at most.
FOLD = 64
MANIFEST = "_manifest.json"


class Conflict(RuntimeError):
    """Another writer moved the pointer since this one read it."""


def write_snapshot(library: Library, root: str, expected: int | None = None) -> str:
    """Save the library and move the pointer; returns the snapshot's name.

    A library read from the current version is saved as changes to it; any other is written whole.  Whole photos are sorted by
    taken_at within files, so date ranges skip row groups.  `expected` is the version that the library
    came from (version()); without it, that of the start of this write.  The next version's pointer is made by one writer
    alone: any other finds it taken, fails with Conflict and leaves the state as it is.
    """
    name = uuid.uuid4().hex
    spark = _session(library)
    now = version(spark, root)
    if expected is not None and expected != now:
        raise Conflict(f"version {now} is current, not {expected}")
    before = read_manifest(spark, root, current_snapshot(spark, root)) if library.source == (root, now) else {}
    manifest = {}
    for table, schema in SCHEMAS.items():
        part = library.part(table)
        if part is not None and not part.whole and table in before and len(part.changes) <= FOLD:
            manifest[table] = _saved_changes(part, before[table], table, root, name)
            continue
        df = spark.createDataFrame([], schema) if part is None else library[table]
        df = df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
        manifest[table] = {"base": f"{name}/{table}", "changes": []}
        if table == "photos":
            textindex.write_indexed(spark, _in_order(df, table), f"{root}/{name}/{table}")
            manifest[table]["grams"] = f"{name}/{table}.grams"
        elif table == "clip_embeddings":
            if vectorindex.write_cells(spark, df, f"{root}/{name}/{table}"):
                manifest[table]["cells"] = True
        else:
            df.write.parquet(f"{root}/{name}/{table}")
    _write_text(spark, f"{root}/{name}/{MANIFEST}", json.dumps(manifest))
    _publish(spark, root, now + 1, name)
    return name


def _session(library: Library) -> SparkSession:
    return library[next(iter(SCHEMAS))].sparkSession


def _in_order(df, table: str):
    return df.sortWithinPartitions("taken_at") if table == "photos" and "taken_at" in df.columns else df


def _saved_changes(part: Part, entry: dict, table: str, root: str, name: str) -> dict:
    """The manifest's entry of a table with its new changes, which are written here."""
    changes = list(entry["changes"])
    for c in part.changes[part.saved :]:
        path = f"{name}/{table}.{c.seq}"
        _in_order(c.rows, table).write.parquet(f"{root}/{path}")
        changes.append({"kind": c.kind, "path": path, "seq": c.seq, "columns": c.rows.columns})
    return entry | {"changes": changes}


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read_manifest(spark: SparkSession, root: str, name: str) -> dict[str, dict]:
    """Base folder and changes of each table; a snapshot without a manifest has all its tables in its own folder."""
    if not _exists(spark, f"{root}/{name}/{MANIFEST}"):
        return {t: {"base": f"{name}/{t}", "changes": []} for t in SCHEMAS}
    return json.loads(_read_text(spark, f"{root}/{name}/{MANIFEST}"))


def _publish(spark: SparkSession, root: str, number: int, name: str) -> None:
    """Make the pointer of a version by a rename that refuses to replace: of two writers one alone succeeds."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/_pointers")
    conf = spark._jsc.hadoopConfiguration()
    fs = folder.getFileSystem(conf)
    whole, target = (fs.makeQualified(jvm.org.apache.hadoop.fs.Path(folder, n)) for n in (f".{name}", f"{number:012d}"))
    out = fs.create(whole, True)
    out.write(bytearray(name.encode()))
    out.close()
    plain = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(whole, target, plain)
    except Py4JJavaError as error:
        fs.delete(whole, False)
        if "AlreadyExists" in error.java_exception.getClass().getName():
            raise Conflict(f"version {number} is taken") from error
        raise


def version(spark: SparkSession, root: str) -> int:
    """Number of the latest snapshot, 0 before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_pointers")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return max((int(n) for n in names if n.isdigit()), default=0)


def current_snapshot(spark: SparkSession, root: str) -> str:
    """Name of the latest snapshot."""
    return _read_text(spark, f"{root}/_pointers/{version(spark, root):012d}").strip()


def optimize_after_import(spark: SparkSession, root: str, file_bytes: int = 128 << 20) -> str:
    """The current snapshot anew in files of about `file_bytes`, the hot tables ordered so that filters skip row groups.

    Imports leave many small files.  Photos are dealt by ranges of taken_at, faces by photo, vectors by model, each with the column
    statistics of Parquet in its footers, which scans read as a planner reads refreshed statistics.
    """
    lib = read_snapshot(spark, root)
    now = version(spark, root)
    order = {"photos": ["taken_at", "id"], "faces": ["photo_id", "id"], "clip_embeddings": ["model", "photo_id"], "person_embeddings": ["person_id", "face_id"]}
    tables = {}
    for name, df in lib.tables.items():
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        files = max(1, -(-size // file_bytes))
        by = order.get(name)
        tables[name] = df.repartitionByRange(files, *by).sortWithinPartitions(*by) if by else df.coalesce(files)
    return write_snapshot(Library(tables), root, now)


def read_snapshot(spark: SparkSession, root: str, name: str | None = None) -> Library:
    """The current snapshot, or the one of a name; its changes are merged as its tables are read."""
    source = None
    if name is None:
        source = (root, version(spark, root))
        name = _read_text(spark, f"{root}/_pointers/{source[1]:012d}").strip()
    parts = {}
    for table, entry in read_manifest(spark, root, name).items():
        fields = {f.name: f for f in SCHEMAS[table].fields}
        changes = tuple(
            Change(c["kind"], spark.read.schema(T.StructType([fields[n] for n in c["columns"]])).parquet(f"{root}/{c['path']}"), c["seq"], True)
            for c in entry["changes"]
        )
        base = spark.read.schema(SCHEMAS[table]).parquet(f"{root}/{entry['base']}")
        index = None
        if "grams" in entry:
            index = spark.read.schema("gram int, chunk long").parquet(f"{root}/{entry['grams']}"), textindex.chunked(spark, f"{root}/{entry['base']}")
        if entry.get("cells"):
            index = vectorindex.with_cells(spark, f"{root}/{entry['base']}")
        parts[table] = Part(base, changes, len(changes), whole=False, index=index)
    return Library(parts, source)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
