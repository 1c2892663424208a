"""Catalogue reads: pages, details, timelines, hidden duplicates, text filters and pending work."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clean_name
from ..schemas import Library
from ..sources.textindex import narrowed

#: Rows of a page.
PAGE = 300
BRIEF = ("id", "file_path", "thumbnail_path")


def _newest(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("taken_at").desc_nulls_last(), F.col("id").desc())


def photo_grid(
    lib: Library, limit: int = PAGE, offset: int = 0, person_id: int | None = None, search: str | None = None
) -> DataFrame:
    """A page of visible photos, newest first; by person, or by a text in path or camera (% and _ are wildcards)."""
    shown = narrowed(lib, [search], "names") if search else lib
    photos = shown.photos.filter(F.col("duplicate_of").isNull())
    if person_id is not None:
        wanted = lib.faces.filter(F.col("person_id") == person_id).select(F.col("photo_id").alias("id"))
        photos = photos.join(wanted, "id", "left_semi")
    if search:
        pattern = f"%{search}%"
        photos = photos.filter(F.col("file_path").ilike(pattern) | F.col("camera_model").ilike(pattern))
    return _newest(photos.select(*BRIEF, "taken_at")).offset(offset).limit(limit)


def photo_grid_after(lib: Library, last_taken_at: datetime | None, last_id: int, limit: int = PAGE) -> DataFrame:
    """The page that follows a photo, by its keys, with no rows skipped one by one."""
    photos = lib.photos.filter(F.col("duplicate_of").isNull())
    undated = F.col("taken_at").isNull()
    if last_taken_at is None:
        after = undated & (F.col("id") < last_id)
    else:
        at = F.lit(last_taken_at).cast("timestamp_ntz")
        after = undated | (F.col("taken_at") < at) | ((F.col("taken_at") == at) & (F.col("id") < last_id))
    return _newest(photos.filter(after).select(*BRIEF, "taken_at")).limit(limit)


DETAIL = (
    "id", "file_path", "file_hash", "file_size", "width", "height", "format", "orientation", "camera_make",
    "camera_model", "taken_at", "gps_latitude", "gps_longitude", "is_favorite", "thumbnail_path",
)


def photo_detail(lib: Library, photo_id: int) -> DataFrame:
    return lib.photos.filter(F.col("id") == photo_id).select(*DETAIL)


def photos_by_ids(lib: Library, ids: Sequence[int]) -> DataFrame:
    return lib.photos.filter(F.col("id").isin(list(ids))).select("id", "file_path").orderBy("id")


def photos_brief(lib: Library, ids: Sequence[int]) -> DataFrame:
    """Brief rows in the order of the ids given; ids without a photo are left out, repeated ones repeat."""
    spark = lib.photos.sparkSession
    wanted = spark.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "position int, id long")
    return lib.photos.select(*BRIEF, "taken_at").join(F.broadcast(wanted), "id").orderBy("position").select("position", *BRIEF, "taken_at")


def photos_largest_first(lib: Library, ids: Sequence[int]) -> DataFrame:
    """Members of a duplicate group, the largest file first."""
    return (
        lib.photos.filter(F.col("id").isin(list(ids)))
        .select("id", "file_path", "thumbnail_path", "file_size")
        .orderBy(F.col("file_size").desc(), "id")
    )


def photos_by_month(lib: Library, year: int, month: int, limit: int = PAGE, offset: int = 0) -> DataFrame:
    """Photos of a month, hidden ones included, by a half-open range that Parquet can skip by."""
    start = datetime(year, month, 1)
    end = datetime(year + month // 12, month % 12 + 1, 1)
    at = F.col("taken_at")
    photos = lib.photos.filter((at >= F.lit(start).cast("timestamp_ntz")) & (at < F.lit(end).cast("timestamp_ntz")))
    return _newest(photos.select(*BRIEF, "taken_at")).offset(offset).limit(limit)


def on_this_day(lib: Library, month: int, day: int, limit: int = 50) -> DataFrame:
    """Photos of this day of any year, the current one included."""
    at = F.col("taken_at")
    return _newest(lib.photos.filter((F.month(at) == month) & (F.dayofmonth(at) == day)).select(*BRIEF, "taken_at")).limit(limit)


def recent_photos(lib: Library, limit: int = 20) -> DataFrame:
    return lib.photos.select(*BRIEF).orderBy(F.col("id").desc()).limit(limit)


def hashed_photos(lib: Library) -> DataFrame:
    """Visible photos with a usable fingerprint; -1 stands for a photo that can't be hashed."""
    return lib.photos.filter("phash is not null and phash <> -1 and duplicate_of is null").select("id", "phash")


def hidden_duplicates(lib: Library, limit: int = 200) -> DataFrame:
    return (
        lib.photos.filter(F.col("duplicate_of").isNotNull())
        .select("id", "file_path", "duplicate_of", "updated_at")
        .orderBy(F.col("updated_at").desc(), F.col("id").desc())
        .limit(limit)
    )


def person_by_name(lib: Library, name: Column | str) -> DataFrame:
    """The person whose trimmed name equals this one, letter case aside, if there is exactly one."""
    wanted = F.lower(clean_name(F.lit(name) if isinstance(name, str) else name))
    return (
        lib.persons.filter(F.lower(F.trim("display_name")) == wanted)
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
        .filter("n = 1")
        .select("id")
    )


#: Search tokens shorter than this are dropped.
TOKEN_LENGTH = 3


def photos_by_ocr(
    lib: Library,
    tokens: Sequence[str],
    limit: int,
    favorite: bool | None = None,
    since: datetime | None = None,
    until: datetime | None = None,
    person_id: int | None = None,
) -> DataFrame:
    """Photos whose recognised text holds any token, newest first; without a long enough token none.

    Of a snapshot's photos only the pages are read that may hold one.
    """
    tokens = [t for t in tokens if len(t) >= TOKEN_LENGTH]
    photos = photo_filters(narrowed(lib, tokens), favorite, since, until, person_id)
    hit = reduce(lambda a, b: a | b, [F.col("ocr_text").ilike(f"%{t}%") for t in tokens], F.lit(False))
    return _newest(photos.filter(hit).select(*BRIEF, "taken_at")).limit(limit)


def photo_filters(
    lib: Library,
    favorite: bool | None = None,
    since: datetime | None = None,
    until: datetime | None = None,
    person_id: int | None = None,
) -> DataFrame:
    """Photos under the filters that searches share; both dates are included."""
    photos = lib.photos
    if favorite is not None:
        photos = photos.filter(F.col("is_favorite") == favorite)
    if since is not None:
        photos = photos.filter(F.col("taken_at") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        photos = photos.filter(F.col("taken_at") <= F.lit(until).cast("timestamp_ntz"))
    if person_id is not None:
        wanted = lib.faces.filter(F.col("person_id") == person_id).select(F.col("photo_id").alias("id"))
        photos = photos.join(wanted, "id", "left_semi")
    return photos


def pending_faces(lib: Library) -> DataFrame:
    return lib.photos.filter(~F.col("faces_processed")).select("id", "file_path")


def pending_thumbnails(lib: Library, regenerate: bool = False) -> DataFrame:
    photos = lib.photos if regenerate else lib.photos.filter(F.col("thumbnail_path").isNull())
    return photos.select("id", "file_path")


def pending_clip(lib: Library, model: str, version: int) -> DataFrame:
    """Photos without a vector of this model and version."""
    done = lib.clip_embeddings.filter((F.col("model") == model) & (F.col("version") == version))
    return lib.photos.join(done.select(F.col("photo_id").alias("id")), "id", "left_anti").select("id", "file_path")


def pending_ocr(lib: Library) -> DataFrame:
    return lib.photos.filter(F.col("ocr_text").isNull()).select("id", "file_path")


def pending_phash(lib: Library) -> DataFrame:
    return lib.photos.filter(F.col("phash").isNull()).select("id", "file_path")


def pending_counts(lib: Library, model: str, version: int) -> DataFrame:
    """One row of pending work by stage; the photos are scanned once."""
    photos = lib.photos.agg(
        F.count_if(~F.col("faces_processed")).alias("faces"),
        F.count_if(F.col("thumbnail_path").isNull()).alias("thumbnails"),
        F.count_if(F.col("ocr_text").isNull()).alias("ocr"),
        F.count_if(F.col("phash").isNull()).alias("phash"),
    )
    clip = pending_clip(lib, model, version).agg(F.count(F.lit(1)).alias("clip"))
    return photos.crossJoin(F.broadcast(clip))  # one row each


def recent_scan_runs(lib: Library, limit: int = 5) -> DataFrame:
    return lib.scan_runs.orderBy(F.col("id").desc()).limit(limit)


def on_this_day_today(lib: Library, limit: int = 50, today: date | None = None) -> DataFrame:
    today = today or date.today()
    return on_this_day(lib, today.month, today.day, limit)
