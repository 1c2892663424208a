"""Export and restore of what people taught the library, by natural keys: file hash and face box."""

from __future__ import annotations

import json
import os
import tempfile
from collections import Counter
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import Library
from .mutations import recompute_profiles, record_feedback

FORMAT = 1
BOX = ("bbox_x", "bbox_y", "bbox_w", "bbox_h")
FACE_KEY = ("file_hash", *BOX)


def face_keys(lib: Library) -> DataFrame:
    """(face_id, person_id, file_hash, box) of all faces."""
    photos = lib.photos.select(F.col("id").alias("photo_id"), "file_hash")
    return lib.faces.select(F.col("id").alias("face_id"), "photo_id", "person_id", *BOX).join(photos, "photo_id").drop("photo_id")


def export_people(lib: Library) -> DataFrame:
    """(name, faces): face keys of each named person in face order; persons of one name come together."""
    named = lib.persons.filter(F.col("display_name").isNotNull()).select(F.col("id").alias("person_id"), F.col("display_name").alias("name"))
    rows = face_keys(lib).join(named, "person_id")
    ordered = F.array_sort(F.collect_list(F.struct("person_id", "face_id", *FACE_KEY)))
    return rows.groupBy("name").agg(F.transform(ordered, lambda x: F.struct(*[x[k].alias(k) for k in FACE_KEY])).alias("faces"))


def export_favorites(lib: Library) -> DataFrame:
    return lib.photos.filter("is_favorite").select("file_hash")


def export_feedback(lib: Library) -> DataFrame:
    """(file_hash, box, person, verdict) of verdicts about named persons."""
    named = lib.persons.filter(F.col("display_name").isNotNull()).select(F.col("id").alias("person_id"), F.col("display_name").alias("person"))
    return (
        lib.recognition_feedback.select("face_id", "person_id", "verdict")
        .join(face_keys(lib).drop("person_id"), "face_id")
        .join(named, "person_id")
        .select(*FACE_KEY, "person", "verdict")
    )


def export_document(lib: Library, now: datetime) -> DataFrame:
    """The whole backup as one row of nested columns, ready for to_json: for libraries that fit one document."""
    key = lambda x: F.array(x["file_hash"], *[x[b].cast("string") for b in BOX])
    people = export_people(lib).agg(F.array_sort(F.collect_list(F.struct("name", F.transform("faces", key).alias("faces")))).alias("people"))
    favorites = export_favorites(lib).agg(F.array_sort(F.collect_list("file_hash")).alias("favorites"))
    feedback = export_feedback(lib).agg(
        F.array_sort(
            F.collect_list(F.struct(F.array("file_hash", *[F.col(b).cast("string") for b in BOX]).alias("face"), "person", "verdict"))
        ).alias("feedback")
    )
    return (
        favorites.crossJoin(people).crossJoin(feedback)
        .select(F.lit(FORMAT).alias("format"), F.lit(now.isoformat(timespec="seconds")).alias("created"), "favorites", "people", "feedback")
    )


def backup(lib: Library, now: datetime) -> dict:
    """The backup as plain values."""
    row = export_document(lib, now).first().asDict(recursive=True)
    box = lambda k: [k[0], *[int(x) for x in k[1:]]]
    for p in row["people"]:
        p["faces"] = [box(k) for k in p["faces"]]
    for f in row["feedback"]:
        f["face"] = box(f["face"])
    return row


def save_backup(data: dict, path: str) -> None:
    """Write in one step: a reader sees the old file or the new one."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, temporary = tempfile.mkstemp(dir=folder)
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(data, f, ensure_ascii=False, indent=1)
    os.replace(temporary, path)


def load_backup(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    problems = backup_problems(data)
    if problems:
        raise ValueError("invalid backup: " + "; ".join(problems))
    return data


def _is_key(value) -> bool:
    return (
        isinstance(value, (list, tuple)) and len(value) == 5 and isinstance(value[0], str)
        and all(isinstance(x, int) and not isinstance(x, bool) for x in value[1:])
    )


def backup_problems(data) -> list[str]:
    """What is wrong with a backup; empty for a good one."""
    if not isinstance(data, dict):
        return ["not an object"]
    found = []
    if data.get("format") != FORMAT:
        found.append(f"format {data.get('format')!r} is not {FORMAT}")
    favorites, people, feedback = (data.get(k, []) for k in ("favorites", "people", "feedback"))
    if not isinstance(favorites, list) or not all(isinstance(x, str) for x in favorites):
        found.append("favorites must be a list of hashes")
    if not isinstance(people, list) or not all(
        isinstance(p, dict) and isinstance(p.get("name"), str) and isinstance(p.get("faces"), list) and all(map(_is_key, p["faces"]))
        for p in people
    ):
        found.append("people must have a name and face keys")
    if not isinstance(feedback, list) or not all(
        isinstance(f, dict) and _is_key(f.get("face")) and isinstance(f.get("person"), str) and f.get("verdict") in ("reject", "confirm")
        for f in feedback
    ):
        found.append("feedback must have a face key, a person and a verdict")
    return found


KEY_SCHEMA = "file_hash string, bbox_x int, bbox_y int, bbox_w int, bbox_h int"


def find_faces(lib: Library, keys: DataFrame) -> DataFrame:
    """keys plus face_id: the least id of a face with this hash and box, null without one."""
    known = face_keys(lib).groupBy(*FACE_KEY).agg(F.min("face_id").alias("face_id"))
    return keys.join(known, list(FACE_KEY), "left")


def restore(lib: Library, data: dict, now: datetime) -> tuple[Library, dict[str, int]]:
    """Apply a backup on top of what is there, and report seven counts; a bad backup changes nothing.

    Persons are found by name or made; galleries are rebuilt by the next update run.
    """
    problems = backup_problems(data)
    if problems:
        raise ValueError("invalid backup: " + "; ".join(problems))
    spark = lib.photos.sparkSession
    report = Counter(favorites=0, favorites_skipped=0, people=0, faces_assigned=0, faces_skipped=0, feedback=0, feedback_skipped=0)

    wanted = spark.createDataFrame([(h,) for h in data.get("favorites", [])], "file_hash string")
    known = lib.photos.select("file_hash").distinct()
    report["favorites"] = wanted.join(known, "file_hash", "left_semi").count()
    report["favorites_skipped"] = len(data.get("favorites", [])) - report["favorites"]
    marked = lib.photos.join(wanted, "file_hash", "left_semi").select("id", F.lit(True).alias("is_favorite"))

    rows = [(i, p["name"], *k) for i, p in enumerate(data.get("people", [])) for k in p["faces"]]
    keys = spark.createDataFrame(rows, f"i int, name string, {KEY_SCHEMA}")
    found = find_faces(lib, keys).filter(F.col("face_id").isNotNull()).select("i", "name", "face_id")
    report["faces_assigned"] = found.count()
    report["faces_skipped"] = len(rows) - report["faces_assigned"]
    by_name = lib.persons.filter(F.col("display_name").isNotNull()).groupBy(F.col("display_name").alias("name")).agg(F.min("id").alias("person_id"))
    # One row for each name of the backup.
    names = found.groupBy("name").agg(F.min("i").alias("i"), F.min_by("face_id", F.struct("i", "face_id")).alias("cover"))
    matched = names.join(by_name, "name", "left").collect()
    top = lib.persons.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    ids, new = {}, []
    for r in sorted(matched, key=lambda r: r["i"]):
        if r["person_id"] is None:
            top += 1
            new.append((top, r["name"], 0, r["cover"], None, None))
            ids[r["name"]] = top
        else:
            ids[r["name"]] = r["person_id"]
    report["people"] = len(new)
    persons = spark.createDataFrame(new, lib.persons.schema)
    table = spark.createDataFrame(list(ids.items()), "name string, _to long")
    # A face named twice goes to the person that comes last.
    moves = found.join(table, "name").groupBy(F.col("face_id").alias("id")).agg(F.max_by("_to", "i").alias("_to"))
    lib = lib.changed("photos", patch=marked).changed("faces", patch=moves.withColumnRenamed("_to", "person_id")).changed("persons", append=persons)
    if ids:
        lib = recompute_profiles(lib, table.select(F.col("_to").alias("id")))

    rows = [(i, f["person"], f["verdict"], *f["face"]) for i, f in enumerate(data.get("feedback", []))]
    keys = spark.createDataFrame(rows, f"i int, name string, verdict string, {KEY_SCHEMA}")
    now_by_name = lib.persons.filter(F.col("display_name").isNotNull()).groupBy(F.col("display_name").alias("name")).agg(F.min("id").alias("person_id"))
    good = find_faces(lib, keys).join(now_by_name, "name").filter(F.col("face_id").isNotNull())
    report["feedback"] = good.count()
    report["feedback_skipped"] = len(rows) - report["feedback"]
    last = good.groupBy("face_id", "person_id").agg(F.max_by("verdict", "i").alias("verdict"))
    lib = record_feedback(lib, last.withColumn("created_at", F.lit(now).cast(T.TimestampNTZType())))
    return lib, dict(report)
