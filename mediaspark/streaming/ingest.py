"""Incremental ingest: a file-source stream whose micro-batches become library snapshots."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import EngineConfig
from ..operators.mutations import finish_scan_run, insert_photos, start_scan_run
from ..schemas import Library
from ..sources.images import image_files, photo_metadata
from ..sources.snapshots import read_snapshot, write_snapshot


def scan(
    lib: Library, files: DataFrame, root: str, now: datetime, listed: DataFrame | None = None
) -> tuple[Library, dict[str, int]]:
    """Take in image files (path, modificationTime, length, content): the library and a summary.

    Known paths are skipped.  A new file counts as a duplicate if a photo has its hash, or an earlier new file has.  `listed`
    (path) are the files that a listing names; a new one of these that could not be read counts as an error.
    """
    lib, run = start_scan_run(lib, root, now)
    known = lib.photos.select(F.col("file_path").alias("path"))
    rows = photo_metadata(files.join(known, "path", "left_anti")).persist()
    try:
        seen = lib.photos.select("file_hash").distinct().withColumn("_seen", F.lit(1))
        new = rows.groupBy("file_hash").agg(F.count(F.lit(1)).alias("n")).join(seen, "file_hash", "left").agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("processed"),
            F.coalesce(F.sum(F.col("n") - F.when(F.col("_seen").isNull(), 1).otherwise(0)), F.lit(0)).alias("duplicates"),
        )
        names = (files if listed is None else listed).select("path").distinct()
        there = names.join(known.withColumn("_known", F.lit(1)), "path", "left").agg(
            F.count("_known").alias("skipped"), F.count(F.lit(1)).alias("all")
        )
        r = new.crossJoin(there).first()  # two single rows
        errors = r["all"] - r["skipped"] - r["processed"] if listed is not None else 0
        summary = {"processed": r["processed"], "skipped": r["skipped"], "duplicates": r["duplicates"], "errors": errors}
        lib = insert_photos(lib, rows, now)
        return finish_scan_run(lib, run, **summary, now=now), summary
    finally:
        rows.unpersist()


def scan_directory(lib: Library, root: str, now: datetime, config: EngineConfig = EngineConfig()) -> tuple[Library, dict[str, int]]:
    """scan() of a folder: files that can't be read are counted and left for the next scan."""
    spark = lib.photos.sparkSession
    return scan(lib, image_files(spark, root, config), root, now, image_files(spark, root, config, content=False))


#: Columns of Spark's binary file source.
FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(
    spark: SparkSession,
    root: str,
    snapshots: str,
    checkpoint: str,
    clock: Callable[[], datetime],
    config: EngineConfig = EngineConfig(),
    once: bool = True,
) -> StreamingQuery:
    """Follow a folder: each micro-batch of new files is scanned into the next snapshot.

    Taking a batch in twice changes nothing, as known paths are skipped, so a restart is safe.  With `once` the
    stream takes all files there are and ends.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).load(root)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    images = files.filter(suffix.isin(list(config.image_suffixes)))

    def take(batch: DataFrame, _: int) -> None:
        lib, summary = scan(read_snapshot(batch.sparkSession, snapshots), batch, root, clock())
        if summary["processed"]:
            write_snapshot(lib, snapshots)

    writer = images.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
