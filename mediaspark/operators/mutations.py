"""Changes of a library: each takes a snapshot and gives the next one; nothing is changed in place.

Foreign keys act as in the schema: rows that depend on a deleted one go (faces of a photo, galleries, feedback,
suggestions, album entries), or lose the reference (a face's person, a cover, duplicate_of).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.scalars import group_key
from ..schemas import KEYS, SCHEMAS, Library
from .graph import cut, settled
from .recognition import person_centroids, refresh_galleries

#: Tables with a column that goes with a face or a person.
FACE_CHILDREN = ("person_embeddings", "recognition_feedback", "recognition_suggestions")
PERSON_CHILDREN = ("person_embeddings", "recognition_feedback", "recognition_suggestions")
PAIR_CHILDREN = ("person_merge_suggestions", "person_merge_rejections")


def _ids(lib: Library, ids: Sequence[int], name: str = "id") -> DataFrame:
    return lib.photos.sparkSession.createDataFrame([(int(i),) for i in ids], f"{name} long")


def _patch(df: DataFrame, where: Column, key: str = "id", **values) -> DataFrame:
    """Keys of the rows where a condition holds, with the columns that a patch sets there."""
    cells = [(v if isinstance(v, Column) else F.lit(v)).cast(df.schema[c].dataType).alias(c) for c, v in values.items()]
    return df.filter(where).select(key, *cells)


def insert_ignore(lib: Library, table: str, new: DataFrame) -> Library:
    """With those new rows whose key is not there yet; of equal new keys one stays."""
    key = list(KEYS[table])
    return lib.changed(table, append=new.dropDuplicates(key).join(lib[table].select(*key), key, "left_anti"))


def upsert(lib: Library, table: str, new: DataFrame, latest: Column | None = None) -> Library:
    """New rows replace old ones of their key; of equal new keys the latest by `latest` stays."""
    if latest is None:
        return lib.changed(table, put=new.dropDuplicates(list(KEYS[table])))
    order = Window.partitionBy(*KEYS[table]).orderBy(latest.desc())
    return lib.changed(table, put=new.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r"))


def _drop_by(lib: Library, table: str, gone: DataFrame) -> Library:
    """Without the rows of a table that agree with `gone` in its columns."""
    key, by = KEYS[table], gone.columns
    rows = gone if set(by) == set(key) else lib[table].join(gone, by, "left_semi").select(*key)
    return lib.changed(table, drop=rows.distinct())


def next_ids(new: DataFrame, old: DataFrame, order: Sequence[str]) -> DataFrame:
    """New rows with ids after the highest old one, in a fixed order.

    Ranks run within the ranges of a sort, whose offsets are summed, so no task numbers all rows.
    """
    from .numbering import number_rows

    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    return number_rows(new, order, "_n").crossJoin(F.broadcast(top)).withColumn("id", F.col("_top") + F.col("_n") + 1).drop("_n", "_top")


def insert_photos(lib: Library, new: DataFrame, now: datetime) -> Library:
    """Photos of paths that are not known yet get ids in path order; known paths are left alone."""
    fresh = new.dropDuplicates(["file_path"]).join(lib.photos.select("file_path"), "file_path", "left_anti")
    have = set(fresh.columns)
    defaults = {"is_favorite": F.lit(False), "faces_processed": F.lit(False), "created_at": F.lit(now), "updated_at": F.lit(now)}
    fresh = fresh.withColumns(
        {
            f.name: defaults.get(f.name, F.lit(None)).cast(f.dataType)
            for f in SCHEMAS["photos"].fields
            if f.name not in have and f.name != "id"
        }
    )
    numbered = next_ids(fresh, lib.photos, ["file_path"])
    return lib.changed("photos", append=numbered)


def replace_faces(lib: Library, photo_ids: DataFrame, faces: DataFrame) -> Library:
    """New faces (photo_id, boxes, det_score, embedding, crop_path) for photos (photo_id), whose old ones go."""
    old = lib.faces.join(photo_ids, "photo_id", "left_semi").select(F.col("id").alias("face_id"))
    lib = delete_faces(lib, old)
    new = next_ids(faces.withColumn("person_id", F.lit(None).cast("long")), lib.faces, ["photo_id", "bbox_x", "bbox_y", "bbox_w", "bbox_h"])
    done = photo_ids.select(F.col("photo_id").alias("id"), F.lit(True).alias("faces_processed")).distinct()
    return lib.changed("faces", append=new).changed("photos", patch=done)


def delete_faces(lib: Library, faces: DataFrame) -> Library:
    """Without some faces (face_id) and what depends on them."""
    gone = faces.select("face_id").distinct()
    covers = lib.persons.join(gone.withColumnRenamed("face_id", "cover_face_id"), "cover_face_id", "left_semi")
    out = lib.changed("persons", patch=covers.select("id", F.lit(None).cast("long").alias("cover_face_id")))
    out = out.changed("faces", drop=gone.withColumnRenamed("face_id", "id"))
    for t in FACE_CHILDREN:
        out = _drop_by(out, t, gone)
    return out


def reset_faces_processed(lib: Library) -> Library:
    return lib.changed("photos", patch=_patch(lib.photos, ~F.coalesce(~F.col("faces_processed"), F.lit(False)), faces_processed=False))


def create_person(lib: Library, face_count: int = 0, cover_face_id: int | None = None, name: str | None = None) -> tuple[Library, int]:
    """A new person and their id."""
    top = lib.persons.agg(F.max("id")).first()[0] or 0
    row = lib.persons.sparkSession.createDataFrame(
        [(top + 1, name.strip() or None if name else None, face_count, cover_face_id, None, None)], SCHEMAS["persons"]
    )
    return lib.changed("persons", append=row), top + 1


def rename_person(lib: Library, person_id: int, name: str | None) -> Library:
    """A blank name takes the name away."""
    clean = (name or "").strip() or None
    row = lib.persons.sparkSession.createDataFrame([(int(person_id), clean)], "id long, display_name string")
    return lib.changed("persons", patch=row)


def assign_faces(lib: Library, person_id: int, face_ids: Sequence[int]) -> Library:
    return lib.changed("faces", patch=_ids(lib, sorted(set(face_ids))).withColumn("person_id", F.lit(person_id).cast("long")))


def detach_faces(lib: Library, face_ids: Sequence[int]) -> Library:
    """Faces lose their person and their place in galleries."""
    return _detached(lib, _ids(lib, sorted(set(face_ids))))


def _detached(lib: Library, faces: DataFrame) -> Library:
    """Faces (id) without their person and their place in galleries."""
    out = lib.changed("faces", patch=faces.withColumn("person_id", F.lit(None).cast("long")))
    return out.changed("person_embeddings", drop=faces.withColumnRenamed("id", "face_id"))


def delete_persons(lib: Library, persons: DataFrame) -> Library:
    """Without some persons (id): their faces stay ungrouped, what depends on them goes."""
    gone = persons.select("id").distinct()
    who = gone.select(F.col("id").alias("person_id"))
    out = lib.changed("faces", patch=lib.faces.join(who, "person_id", "left_semi").select("id", F.lit(None).cast("long").alias("person_id")))
    for t in PERSON_CHILDREN:
        out = _drop_by(out, t, who)
    for t in PAIR_CHILDREN:
        for side in ("person_a", "person_b"):
            out = _drop_by(out, t, gone.withColumnRenamed("id", side))
    return out.changed("persons", drop=gone)


def clear_persons(lib: Library) -> Library:
    """No person is left, and no face has one."""
    empty = {t: lib[t].limit(0) for t in ("persons", *PERSON_CHILDREN, *PAIR_CHILDREN)}
    return lib.changed("faces", patch=_patch(lib.faces, F.col("person_id").isNotNull(), person_id=None)).with_tables(**empty)


def recompute_profiles(lib: Library, persons: DataFrame) -> Library:
    """Face counts and centroids (mean of raw vectors) of some persons (id) from their faces."""
    faces = lib.faces.join(persons.select(F.col("id").alias("person_id")).distinct(), "person_id", "left_semi")
    fresh = faces.groupBy("person_id").agg(F.count(F.lit(1)).cast("int").alias("_n")).join(
        person_centroids(faces, normalize_rows=False).withColumnRenamed("centroid", "_c"), "person_id"
    )
    rows = persons.select("id").distinct().join(fresh.withColumnRenamed("person_id", "id"), "id", "left")
    return lib.changed(
        "persons",
        patch=rows.select("id", F.coalesce("_n", F.lit(0)).cast("int").alias("face_count"), F.col("_c").cast("array<float>").alias("centroid")),
    )


def merge_many(lib: Library, merges: Sequence[tuple[int, int]], config: EngineConfig) -> Library:
    """Merge persons (source, target) in order: faces move to the survivor, sources go with their galleries and feedback.

    Survivors get new profiles and galleries; covers stay.  A merge of a person with themselves does nothing.
    """
    final: dict[int, int] = {}
    for source, target in merges:
        if source != target:
            final[source] = target
    for s in list(final):
        t = final[s]
        while t in final:
            t = final[t]
        final[s] = t
    if not final:
        return lib
    spark = lib.persons.sparkSession
    return merge_into(lib, spark.createDataFrame([(s, t) for s, t in final.items()], "person_id long, _to long"), config)


def merge_into(lib: Library, moves: DataFrame, config: EngineConfig) -> Library:
    """Merge persons (person_id) into survivors (_to) that are merged into nobody themselves."""
    moved = lib.faces.join(moves, "person_id").select("id", F.col("_to").alias("person_id"))
    lib = lib.changed("faces", patch=moved)
    lib = delete_persons(lib, moves.select(F.col("person_id").alias("id")))
    targets = moves.select(F.col("_to").alias("id")).distinct()
    lib = settled(recompute_profiles(lib, targets), "faces", "persons", "person_embeddings")
    from .recognition import store_faces

    mine = lib.faces.join(targets.withColumnRenamed("id", "person_id"), "person_id", "left_semi")
    return refresh_galleries(store_faces(lib, mine, config, ensure_one=True), config, targets)


def merge_persons(lib: Library, source: int, target: int, config: EngineConfig) -> Library:
    return merge_many(lib, [(source, target)], config)


def record_feedback(lib: Library, verdicts: DataFrame) -> Library:
    """Verdicts (face_id, person_id, verdict, created_at); the last one of a pair counts."""
    return upsert(lib, "recognition_feedback", verdicts, F.col("created_at"))


def record_suggestions(lib: Library, rows: DataFrame) -> Library:
    return upsert(lib, "recognition_suggestions", rows, F.col("score"))


def delete_suggestion(lib: Library, face_id: int) -> Library:
    return lib.changed("recognition_suggestions", drop=_ids(lib, [face_id], "face_id"))


def replace_merge_suggestions(lib: Library, rows: DataFrame) -> Library:
    """All suggestions anew, each pair in order."""
    ordered = rows.select(F.least("person_a", "person_b").alias("person_a"), F.greatest("person_a", "person_b").alias("person_b"), "score")
    return lib.with_tables(person_merge_suggestions=ordered.dropDuplicates(["person_a", "person_b"]))


def reject_merge(lib: Library, a: int, b: int) -> Library:
    """The pair is never suggested again."""
    a, b = min(a, b), max(a, b)
    row = lib.persons.sparkSession.createDataFrame([(a, b)], "person_a long, person_b long")
    return insert_ignore(lib, "person_merge_rejections", row).changed("person_merge_suggestions", drop=row)


def _verdict(lib: Library, face_ids: Sequence[int], person_id: int, verdict: str, now: datetime) -> Library:
    rows = [(int(f), int(person_id), verdict, now) for f in face_ids]
    return record_feedback(lib, lib.persons.sparkSession.createDataFrame(rows, SCHEMAS["recognition_feedback"]))


def confirm_face(lib: Library, face_id: int, person_id: int, config: EngineConfig, now: datetime) -> Library:
    """The face is the person's: assigned, stored in the gallery, its suggestion settled."""
    from .recognition import store_faces

    lib = delete_suggestion(_verdict(assign_faces(lib, person_id, [face_id]), [face_id], person_id, "confirm", now), face_id)
    who = _ids(lib, [person_id])
    lib = recompute_profiles(lib, who)
    return refresh_galleries(store_faces(lib, lib.faces.filter(F.col("id") == face_id), config, True), config, who)


def reject_suggestion(lib: Library, face_id: int, person_id: int, now: datetime) -> Library:
    return delete_suggestion(_verdict(lib, [face_id], person_id, "reject", now), face_id)


def _take_from_person(lib: Library, faces: DataFrame, person_id: int, config: EngineConfig, now: datetime) -> Library:
    """Without some faces (id) of a person; nothing but whether one is left reaches the driver."""
    verdicts = faces.select(
        F.col("id").alias("face_id"), F.lit(person_id).cast("long").alias("person_id"), F.lit("reject").alias("verdict"), F.lit(now).cast("timestamp_ntz").alias("created_at")
    )
    lib = record_feedback(_detached(lib, faces), verdicts)
    who = _ids(lib, [person_id])
    if not lib.faces.filter(F.col("person_id") == person_id).limit(1).count():
        return delete_persons(lib, who)
    return refresh_galleries(recompute_profiles(lib, who), config, who)


def reject_representative(lib: Library, person_id: int, face_id: int, config: EngineConfig, now: datetime) -> Library:
    """The face is not the person's; a person left without faces goes."""
    return _take_from_person(lib, _ids(lib, [face_id]), person_id, config, now)


def remove_person_from_photos(lib: Library, person_id: int, photo_ids: Sequence[int], config: EngineConfig, now: datetime) -> Library:
    """The person is on none of these photos."""
    mine = lib.faces.filter((F.col("person_id") == person_id) & F.col("photo_id").isin(list(photo_ids)))
    faces = cut(mine.select("id"))
    return lib if faces.isEmpty() else _take_from_person(lib, faces, person_id, config, now)


def set_photo_values(lib: Library, values: DataFrame, column: str) -> Library:
    """phash, thumbnail_path, ocr_text or is_favorite of photos from rows (id, value); other photos, and those with a null value, keep theirs."""
    if column not in ("phash", "thumbnail_path", "ocr_text", "is_favorite"):
        raise ValueError(column)
    return lib.changed("photos", patch=values.filter("value is not null").select("id", F.col("value").alias(column)))


def mark_duplicates(lib: Library, keep_id: int, hide_ids: Sequence[int]) -> Library:
    """Hide all members but one behind it."""
    rows = [(int(i), int(keep_id)) for i in sorted(set(hide_ids)) if i != keep_id] + [(int(keep_id), None)]
    return lib.changed("photos", patch=lib.photos.sparkSession.createDataFrame(rows, "id long, duplicate_of long"))


def restore_duplicate(lib: Library, photo_id: int) -> Library:
    row = lib.photos.sparkSession.createDataFrame([(int(photo_id), None)], "id long, duplicate_of long")
    return lib.changed("photos", patch=row)


def dismiss_group(lib: Library, photo_ids: Sequence[int]) -> Library:
    """This very set of photos is no duplicate group."""
    row = lib.photos.sparkSession.range(1).select(group_key(F.array(*[F.lit(int(i)) for i in photo_ids])).alias("group_key"))
    return insert_ignore(lib, "duplicate_dismissals", row)


def create_album(lib: Library, name: str, now: datetime) -> tuple[Library, int]:
    top = lib.albums.agg(F.max("id")).first()[0]
    new = 1 if top is None else top + 1
    row = lib.albums.sparkSession.createDataFrame([(new, name, None, now, now)], SCHEMAS["albums"])
    return lib.changed("albums", append=row), new


def rename_album(lib: Library, album_id: int, name: str, now: datetime) -> Library:
    return lib.changed("albums", patch=_patch(lib.albums, F.col("id") == album_id, name=name, updated_at=now))


def delete_album(lib: Library, album_id: int) -> Library:
    """The album goes, its photos stay."""
    return _drop_by(lib.changed("albums", drop=_ids(lib, [album_id])), "album_photos", _ids(lib, [album_id], "album_id"))


def add_to_album(lib: Library, album_id: int, photo_ids: Sequence[int], now: datetime) -> tuple[Library, int]:
    """Add photos and tell how many were new; the first becomes the cover of an album without one."""
    spark = lib.albums.sparkSession
    rows = spark.createDataFrame([(album_id, int(i), now) for i in photo_ids], SCHEMAS["album_photos"])
    added = rows.dropDuplicates(["photo_id"]).join(lib.album_photos.select("album_id", "photo_id"), ["album_id", "photo_id"], "left_anti").count()
    here = F.col("id") == album_id
    out = insert_ignore(lib, "album_photos", rows).changed("albums", patch=_patch(lib.albums, here, updated_at=now))
    if photo_ids:
        out = out.changed("albums", patch=_patch(lib.albums, here & F.col("cover_photo_id").isNull(), cover_photo_id=int(photo_ids[0])))
    return out, added


def remove_from_album(lib: Library, album_id: int, photo_ids: Sequence[int]) -> Library:
    rows = [(int(album_id), int(i)) for i in sorted(set(photo_ids))]
    return lib.changed("album_photos", drop=lib.albums.sparkSession.createDataFrame(rows, "album_id long, photo_id long"))


def upsert_clip(lib: Library, rows: DataFrame) -> Library:
    """One vector a photo: the new one replaces the old, whatever its model."""
    return upsert(lib, "clip_embeddings", rows)


def start_scan_run(lib: Library, root: str, now: datetime) -> tuple[Library, int]:
    top = lib.scan_runs.agg(F.max("id")).first()[0]
    new = 1 if top is None else top + 1
    row = lib.scan_runs.sparkSession.createDataFrame([(new, root, 0, 0, 0, 0, now, None)], SCHEMAS["scan_runs"])
    return lib.changed("scan_runs", append=row), new


def finish_scan_run(lib: Library, run_id: int, processed: int, skipped: int, duplicates: int, errors: int, now: datetime) -> Library:
    done = dict(processed=processed, skipped=skipped, duplicates=duplicates, errors=errors, finished_at=now)
    return lib.changed("scan_runs", patch=_patch(lib.scan_runs, F.col("id") == run_id, **done))


def reset_library(lib: Library) -> Library:
    """All tables empty."""
    return Library.empty(lib.photos.sparkSession)
