"""Counts, timelines and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import Library


def _one_row(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Side by side; each has one row."""
    for other in others:
        first = first.crossJoin(F.broadcast(other))
    return first


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def library_stats(lib: Library) -> DataFrame:
    """photos, faces, persons and bytes; hidden duplicates count too."""
    photos = lib.photos.agg(F.count(F.lit(1)).alias("photos"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))
    return _one_row(photos, _count(lib.faces, "faces"), _count(lib.persons, "persons"))


def knowledge_stats(lib: Library) -> DataFrame:
    """What is known about the library: twelve figures in one row, each table scanned once."""
    photos = lib.photos.agg(
        F.count(F.lit(1)).alias("photos"),
        F.count("taken_at").alias("dated"),
        F.count("gps_latitude").alias("located"),
        F.count_if(F.col("ocr_text").isNotNull() & (F.col("ocr_text") != "")).alias("with_text"),
        F.min("taken_at").alias("first_date"),
        F.max("taken_at").alias("last_date"),
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("storage_bytes"),
    )
    faces = lib.faces.agg(F.count(F.lit(1)).alias("faces"), F.count_if(F.col("person_id").isNull()).alias("faces_ungrouped"))
    persons = lib.persons.agg(F.count(F.lit(1)).alias("persons"), F.count("display_name").alias("named_persons"))
    return _one_row(photos, faces, persons, _count(lib.clip_embeddings, "searchable"))


def counts(lib: Library) -> DataFrame:
    """Global counts: photos, faces, ungrouped, persons, albums, hidden, vectors, texts, suggestions, merges."""
    return _one_row(
        lib.photos.agg(
            F.count(F.lit(1)).alias("photos"),
            F.count_if(F.col("duplicate_of").isNotNull()).alias("hidden"),
            F.count_if(F.col("ocr_text").isNotNull() & (F.col("ocr_text") != "")).alias("ocr_texts"),
        ),
        lib.faces.agg(F.count(F.lit(1)).alias("faces"), F.count_if(F.col("person_id").isNull()).alias("ungrouped")),
        _count(lib.persons, "persons"),
        _count(lib.albums, "albums"),
        _count(lib.clip_embeddings, "clip"),
        _count(open_suggestions(lib), "suggestions"),
        _count(lib.person_merge_suggestions, "merge_suggestions"),
    )


def open_suggestions(lib: Library) -> DataFrame:
    """Suggestions whose face has no person yet."""
    free = lib.faces.filter(F.col("person_id").isNull()).select(F.col("id").alias("face_id"))
    return lib.recognition_suggestions.join(free, "face_id", "left_semi")


def review_count(lib: Library) -> DataFrame:
    """Open face suggestions and merge suggestions together."""
    both = _one_row(_count(open_suggestions(lib), "f"), _count(lib.person_merge_suggestions, "m"))
    return both.select((F.col("f") + F.col("m")).alias("review_count"))


def timeline_buckets(lib: Library) -> DataFrame:
    """Photos by year and month, latest first; undated ones are left out, hidden ones count."""
    at = F.col("taken_at")
    return (
        lib.photos.filter(at.isNotNull())
        .groupBy(F.year(at).alias("year"), F.month(at).alias("month"))
        .agg(F.count(F.lit(1)).alias("photos"))
        .orderBy(F.desc("year"), F.desc("month"))
    )


def person_profile(lib: Library, person_id: int) -> DataFrame:
    """One row: first and last date, number of photos and cover; zero and nulls for a person without faces."""
    mine = lib.faces.filter(F.col("person_id") == person_id).select("photo_id").distinct()
    seen = lib.photos.select(F.col("id").alias("photo_id"), "taken_at").join(mine, "photo_id").agg(
        F.count(F.lit(1)).alias("photo_count"), F.min("taken_at").alias("first_seen"), F.max("taken_at").alias("last_seen")
    )
    person = lib.persons.filter(F.col("id") == person_id).select(F.col("cover_face_id").alias("id"))
    cover = lib.faces.join(F.broadcast(person), "id").agg(F.max("crop_path").alias("cover_path"))  # one person
    return _one_row(seen, cover)


def appears_with(lib: Library, person_id: int, limit: int = 8) -> DataFrame:
    """Other persons by the number of photos shared with this one.

    This person's photos are made distinct first, so a photo with many of their faces joins once.
    """
    mine = lib.faces.filter(F.col("person_id") == person_id).select("photo_id").distinct()
    others = lib.faces.filter(F.col("person_id") != person_id).select("photo_id", "person_id").distinct()
    shared = others.join(mine, "photo_id", "left_semi").groupBy(F.col("person_id").alias("id")).agg(
        F.count(F.lit(1)).alias("shared")
    )
    top = lib.persons.select("id", "display_name", "cover_face_id").join(shared, "id").orderBy(F.desc("shared"), "id").limit(limit)
    crops = lib.faces.select(F.col("id").alias("cover_face_id"), "crop_path")
    return top.join(crops, "cover_face_id", "left").select("id", "display_name", "shared", "crop_path").orderBy(
        F.desc("shared"), "id"
    )


def photo_people(lib: Library, photo_id: int) -> DataFrame:
    """Persons on a photo, by name with the unnamed last."""
    here = lib.faces.filter(F.col("photo_id") == photo_id).select(F.col("person_id").alias("id"), "crop_path").distinct()
    return lib.persons.select("id", "display_name").join(here, "id").orderBy(
        F.col("display_name").asc_nulls_last(), "id", "crop_path"
    )


def persons_with_cover(lib: Library) -> DataFrame:
    """Persons with their cover face's crop, by number of faces."""
    cover = lib.faces.select(F.col("id").alias("cover_face_id"), "crop_path")
    return (
        lib.persons.select("id", "display_name", "face_count", "cover_face_id")
        .join(cover, "cover_face_id", "left")
        .select("id", "display_name", "face_count", F.col("crop_path").alias("cover_path"))
        .orderBy(F.desc("face_count"), "id")
    )


def albums(lib: Library) -> DataFrame:
    """Albums with photo counts and cover thumbnails, the last changed first."""
    sizes = lib.album_photos.groupBy(F.col("album_id").alias("id")).agg(F.count(F.lit(1)).alias("photos"))
    cover = lib.photos.select(F.col("id").alias("cover_photo_id"), F.col("thumbnail_path").alias("cover_path"))
    return (
        lib.albums.join(sizes, "id", "left")
        .join(cover, "cover_photo_id", "left")
        .select("id", "name", F.coalesce("photos", F.lit(0)).alias("photos"), "cover_path", "updated_at")
        .orderBy(F.desc("updated_at"), F.desc("id"))
    )


def album_photos(lib: Library, album_id: int, limit: int = 300, offset: int = 0) -> DataFrame:
    """A page of an album, newest first."""
    members = lib.album_photos.filter(F.col("album_id") == album_id).select(F.col("photo_id").alias("id"))
    return (
        lib.photos.join(members, "id", "left_semi")
        .select("id", "file_path", "thumbnail_path", "is_favorite", "taken_at")
        .orderBy(F.col("taken_at").desc_nulls_last(), F.desc("id"))
        .offset(offset)
        .limit(limit)
    )
