"""Near duplicates by perceptual hash: pairs, groups and their review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import group_key
from ..schemas import Library
from .browse import hashed_photos
from .graph import components
from .hamming import hamming_join

#: Distances under this one.
BANDS = 8


def hamming_pairs(hashes: DataFrame, max_distance: int = 5) -> DataFrame:
    """(a, b, distance) of distinct fingerprints within max_distance, from rows (phash); each pair once, a under b.

    It runs over distinct fingerprints: copies are one value.
    """
    return hamming_join(hashes, _distance(max_distance))


def _distance(max_distance: int) -> int:
    if not 0 <= max_distance < BANDS:
        raise ValueError(f"max_distance must be under {BANDS}")
    return max_distance


def photo_groups(photos: DataFrame, max_distance: int = 5) -> DataFrame:
    """(group_id, id) of photos (id, phash) that chains of near fingerprints join, groups of two or more."""
    pairs = hamming_join(photos, _distance(max_distance), spanning=True)
    named = components(pairs.select("a", "b"))
    labelled = photos.select("id", "phash").join(named.withColumnRenamed("id", "phash"), "phash", "left").select(
        "id", F.coalesce("component", "phash").alias("g")
    )
    groups = labelled.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("group_id")).filter("n > 1")
    return labelled.join(groups, "g").select("group_id", "id", "n")


def duplicate_groups(lib: Library, max_distance: int = 5, limit: int | None = 50) -> DataFrame:
    """Groups to review: group_id, group_key, size and ids; dismissed sets are left out.

    The `limit` largest come, largest first; None gives all, in no order.

    A dismissed set comes back if its members change, since the key is the whole set.
    """
    members = photo_groups(hashed_photos(lib), max_distance)
    groups = members.groupBy("group_id").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(
        "group_id", group_key(F.col("ids")).alias("group_key"), F.size("ids").alias("size"), "ids"
    )
    groups = groups.join(lib.duplicate_dismissals.select("group_key"), "group_key", "left_anti")
    return groups if limit is None else groups.orderBy(F.desc("size"), "group_id").limit(limit)


def group_members(lib: Library, groups: DataFrame) -> DataFrame:
    """Photos of groups, in each the largest file first: group_id, position, id, file_path, file_size."""
    from pyspark.sql import Window

    flat = groups.select("group_id", F.explode("ids").alias("id"))
    largest = Window.partitionBy("group_id").orderBy(F.desc("file_size"), "id")
    return lib.photos.select("id", "file_path", "file_size").join(flat, "id").select(
        "group_id", F.row_number().over(largest).alias("position"), "id", "file_path", "file_size"
    )


def exact_duplicates(lib: Library) -> DataFrame:
    """Photos whose file hash an earlier photo has: id, original."""
    first = lib.photos.groupBy("file_hash").agg(F.min("id").alias("original"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return lib.photos.select("id", "file_hash").join(first, "file_hash").filter("id <> original").select("id", "original")


def duplicate_review_count(lib: Library, max_distance: int = 5) -> DataFrame:
    return duplicate_groups(lib, max_distance, 10_000).agg(F.count(F.lit(1)).alias("groups"))
