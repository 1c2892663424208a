"""Detection of persons that are one identity."""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.vectors import l2_normalize
from ..schemas import Library
from .graph import components, cut
from .recognition import best_scores


def person_pairs(lib: Library, least: float) -> DataFrame:
    """(person_a, person_b, score) with a < b: the best cosine between their representatives or centroids, at least `least`."""
    reps = lib.person_embeddings.filter("is_representative").select("person_id", l2_normalize(F.col("embedding")).alias("vector"))
    bare = lib.persons.select(F.col("id").alias("person_id"), "centroid").filter(F.col("centroid").isNotNull())
    bare = bare.join(reps.select("person_id"), "person_id", "left_anti").select("person_id", l2_normalize(F.col("centroid")).alias("vector"))
    vectors = reps.unionByName(bare)
    pairs = best_scores(vectors.withColumnRenamed("person_id", "face_id"), vectors, least)
    return pairs.filter("face_id < person_id").select(
        F.col("face_id").alias("person_a"), F.col("person_id").alias("person_b"), "score"
    )


def merge_candidates(lib: Library, config: EngineConfig) -> DataFrame:
    """Pairs over the suggestion threshold that nobody rejected, with names and sizes of both."""
    side = lambda x: lib.persons.select(
        F.col("id").alias(f"person_{x}"), F.col("display_name").alias(f"name_{x}"), F.col("face_count").alias(f"size_{x}")
    )
    return (
        person_pairs(lib, config.merge_suggest_threshold)
        .join(lib.person_merge_rejections.select("person_a", "person_b"), ["person_a", "person_b"], "left_anti")
        .join(side("a"), "person_a")
        .join(side("b"), "person_b")
    )


def fold_merges(pairs: list[tuple], rejected: set[tuple[int, int]], auto: float) -> tuple[list[tuple], list[tuple]]:
    """Merges (source, target) in order, and suggestions (a, b, score), from candidates (a, b, score, names, sizes).

    The strongest pair comes first; a pair over `auto` of two unnamed persons merges the smaller (the first
    on equal sizes) into the larger, and later pairs see the survivor with the sizes added up.  This is the plain form of what
    scan_for_merges() does over tables.
    """
    can = [p for p in pairs if p[2] >= auto and p[3] is None and p[4] is None]
    merges = fold_component([(p[0], p[1], p[2], p[5] or 0, p[6] or 0) for p in sorted(can, key=lambda p: (-p[2], p[0], p[1]))])
    alias = dict(merges)

    def now(p: int) -> int:
        while p in alias:
            p = alias[p]
        return p

    left, seen = [], set()
    for a, b, score, *_ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        a, b = sorted((now(a), now(b)))
        if a != b and (a, b) not in seen and (a, b) not in rejected:
            seen.add((a, b))
            left.append((a, b, score))
    return merges, left


def fold_component(pairs) -> list[tuple[int, int]]:
    """Merges (source, target) in order of pairs (a, b, score, size_a, size_b) that may all merge, strongest first."""
    alias: dict[int, int] = {}
    sizes: dict[int, int] = {}

    def now(p: int) -> int:
        while p in alias:
            p = alias[p]
        return p

    merges = []
    for a, b, _, size_a, size_b in pairs:
        sizes.setdefault(a, size_a)
        sizes.setdefault(b, size_b)
        a, b = now(a), now(b)
        if a != b:
            source, target = (a, b) if sizes[a] <= sizes[b] else (b, a)
            sizes[target] += sizes[source]
            alias[source] = target
            merges.append((source, target))
    return merges


def merge_survivors(pairs: DataFrame, auto: float) -> DataFrame:
    """(person_id, survivor) of all persons that the candidates (person_a, person_b, score, names, sizes) merge into another.

    Whatever the order, persons that pairs over `auto` of unnamed persons join end as one, so these pairs' components are
    independent; the order tells who survives.  Each component is folded by a task that streams its pairs, strongest first, and holds
    its persons' sizes; no pair reaches the driver.
    """
    can = pairs.filter((F.col("score") >= auto) & F.col("name_a").isNull() & F.col("name_b").isNull())
    can = can.select("person_a", "person_b", "score", F.coalesce("size_a", F.lit(0)).cast("long").alias("size_a"), F.coalesce("size_b", F.lit(0)).cast("long").alias("size_b"))
    can = cut(can)
    named = components(can.select(F.col("person_a").alias("a"), F.col("person_b").alias("b")))
    rows = can.join(named.select(F.col("id").alias("person_a"), "component"), "person_a")
    dealt = rows.select("component", "person_a", "person_b", "score", "size_a", "size_b").repartition("component")
    ordered = dealt.sortWithinPartitions("component", F.desc("score"), "person_a", "person_b")

    def run(batches):
        rows_of = ((row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns])))
        for _, group in groupby(rows_of, key=lambda r: r[0]):
            alias = dict(fold_component(r[1:] for r in group))
            out = []
            for p in alias:
                t = alias[p]
                while t in alias:
                    t = alias[t]
                out.append((p, t))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["person_id", "survivor"])

    return ordered.mapInArrow(run, "person_id long, survivor long")


def scan_for_merges(lib: Library, config: EngineConfig) -> tuple[Library, int, int]:
    """Merge what is surely one person, suggest the rest: the library, merges done and suggestions.

    The strongest pair comes first; a pair over the automatic threshold of two unnamed persons merges the smaller into the larger.  A
    pair that is left is suggested between the survivors of both, once and with its best score, unless it was rejected.
    """
    from .mutations import merge_into

    pairs = cut(merge_candidates(lib, config).select("person_a", "person_b", "score", "name_a", "name_b", "size_a", "size_b"))
    survivors = cut(merge_survivors(pairs, config.merge_auto_threshold))
    left = pairs.select("person_a", "person_b", "score")
    for side in ("person_a", "person_b"):
        moved = survivors.select(F.col("person_id").alias(side), F.col("survivor").alias("_to"))
        left = left.join(moved, side, "left").withColumn(side, F.coalesce("_to", side)).drop("_to")
    a, b = F.least("person_a", "person_b"), F.greatest("person_a", "person_b")
    left = left.select(a.alias("person_a"), b.alias("person_b"), "score").filter("person_a <> person_b")
    left = left.groupBy("person_a", "person_b").agg(F.max("score").alias("score"))
    suggestions = cut(left.join(lib.person_merge_rejections.select("person_a", "person_b"), ["person_a", "person_b"], "left_anti"))
    merged = survivors.count()
    if merged:
        lib = merge_into(lib, survivors.select("person_id", F.col("survivor").alias("_to")), config)
    return lib.with_tables(person_merge_suggestions=suggestions), merged, suggestions.count()


def review_direction(name_a: Column, name_b: Column, size_a: Column, size_b: Column) -> Column:
    """'a' or 'b': which of two suggested persons stays; the named one, else the larger, a on equal terms."""
    only_b = name_a.isNull() & name_b.isNotNull()
    only_a = name_a.isNotNull() & name_b.isNull()
    return F.when(only_a, "a").when(only_b, "b").when(F.coalesce(size_a, F.lit(0)) >= F.coalesce(size_b, F.lit(0)), "a").otherwise("b")


def merge_suggestions_detail(lib: Library) -> DataFrame:
    """Suggestions with names, sizes and cover crops of both persons and who stays, strongest first."""
    side = lambda x: lib.persons.select(
        F.col("id").alias(f"person_{x}"), F.col("display_name").alias(f"name_{x}"),
        F.col("face_count").alias(f"size_{x}"), F.col("cover_face_id").alias(f"cover_{x}"),
    )
    crop = lambda x: lib.faces.select(F.col("id").alias(f"cover_{x}"), F.col("crop_path").alias(f"crop_{x}"))
    return (
        lib.person_merge_suggestions.join(side("a"), "person_a").join(side("b"), "person_b")
        .join(crop("a"), "cover_a", "left").join(crop("b"), "cover_b", "left")
        .select(
            "person_a", "person_b", "score", "name_a", "name_b", "size_a", "size_b", "crop_a", "crop_b",
            review_direction(F.col("name_a"), F.col("name_b"), F.col("size_a"), F.col("size_b")).alias("keep"),
        )
        .orderBy(F.desc("score"), "person_a", "person_b")
    )


def suggestions_detail(lib: Library, limit: int | None = None, person_id: int | None = None) -> DataFrame:
    """Open face suggestions with the person's name and cover and the face's crop, best first."""
    rows = lib.recognition_suggestions
    if person_id is not None:
        rows = rows.filter(F.col("person_id") == person_id)
    faces = lib.faces.filter(F.col("person_id").isNull()).select(F.col("id").alias("face_id"), "photo_id", "crop_path")
    persons = lib.persons.select(F.col("id").alias("person_id"), "display_name", "cover_face_id")
    cover = lib.faces.select(F.col("id").alias("cover_face_id"), F.col("crop_path").alias("cover_path"))
    out = (
        rows.join(faces, "face_id").join(persons, "person_id").join(cover, "cover_face_id", "left")
        .select("face_id", "person_id", "score", "display_name", "photo_id", "crop_path", "cover_path")
        .orderBy(F.desc("score"), "face_id")
    )
    return out if limit is None else out.limit(limit)


def representatives_detail(lib: Library, person_id: int) -> DataFrame:
    """Representatives of a person with their faces' photos and crops, best quality first."""
    mine = lib.person_embeddings.filter((F.col("person_id") == person_id) & F.col("is_representative")).select("face_id", "quality")
    faces = lib.faces.select(F.col("id").alias("face_id"), "photo_id", "crop_path")
    photos = lib.photos.select(F.col("id").alias("photo_id"), "file_path", "taken_at")
    return (
        mine.join(faces, "face_id").join(photos, "photo_id")
        .select("face_id", "photo_id", "crop_path", "file_path", "taken_at", "quality")
        .orderBy(F.desc("quality"), "face_id")
    )
