"""Identity recognition: galleries, adaptive thresholds, matching with context, suggestions and the update run."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.scalars import adaptive_threshold, context_score, face_quality, gps_cell, neighbour_cells
from ..functions.vectors import consistency, dot, l2_normalize, mean_vector, running_centroid
from ..schemas import Library
from .graph import cut, settled
from .products import near_products


def with_quality(faces: DataFrame) -> DataFrame:
    """faces plus quality."""
    return faces.withColumn("quality", face_quality(F.col("det_score"), F.col("bbox_w"), F.col("bbox_h")))


def gallery_candidates(faces: DataFrame, config: EngineConfig, ensure_one: bool = True) -> DataFrame:
    """Faces (person_id, id, quality) good enough to store; with ensure_one the best of a person who has none such."""
    rows = faces if "quality" in faces.columns else with_quality(faces)
    good = F.col("quality") >= config.face_quality_store_min
    if not ensure_one:
        return rows.filter(good)
    # One row a person, summed up where the faces are: a person of very many faces is not gathered.
    best = rows.groupBy("person_id").agg(F.max_by("id", F.struct("quality", -F.col("id"))).alias("_best"))
    return rows.join(best, "person_id").filter(good | (F.col("id") == F.col("_best"))).select(*rows.columns)


def choose_representatives(vectors: np.ndarray, qualities: np.ndarray, config: EngineConfig) -> list[int]:
    """Greedy choice by quality: at most max representatives, none too near a chosen one, weak ones only as the first.

    `vectors` are rows of length 1, in the order of preference among equal qualities.
    """
    chosen: list[int] = []
    for i in np.argsort(-qualities, kind="stable").tolist():
        if chosen and qualities[i] < config.face_quality_learn_min:
            break  # the order falls, so all that follow are weak too
        if chosen and float((vectors[chosen] @ vectors[i]).max()) > config.representative_diversity_sim:
            continue
        chosen.append(i)
        if len(chosen) == config.person_max_representatives:
            break
    return chosen


def representatives(gallery: DataFrame, config: EngineConfig) -> DataFrame:
    """(person_id, face_id) of the representatives of a gallery (person_id, face_id, embedding, quality).

    The choice depends on the choices before it, so a task streams its persons' faces, best first, and holds no more than the chosen
    few of one person.  The rest of a person is passed over once the few are full or the first weak face comes; weak
    faces but each person's best are not even sent.  Equal qualities prefer the greater face id.
    """
    best = gallery.groupBy("person_id").agg(F.max_by("face_id", F.struct("quality", "face_id")).alias("_best"))
    rows = gallery.select("person_id", "face_id", "embedding", "quality").join(best, "person_id")
    rows = rows.filter((F.col("quality") >= config.face_quality_learn_min) | (F.col("face_id") == F.col("_best"))).drop("_best")
    order = [F.col("person_id"), F.desc("quality"), F.desc("face_id")]
    most, weak, alike = config.person_max_representatives, config.face_quality_learn_min, config.representative_diversity_sim

    def run(batches):
        person, chosen, done = None, [], False
        for batch in batches:
            persons, ids, qualities = (batch.column(i).to_pylist() for i in (0, 1, 3))
            picked = []
            for k, (who, face, quality) in enumerate(zip(persons, ids, qualities)):
                if who != person:
                    person, chosen, done = who, [], False
                if done:
                    continue
                if chosen and quality < weak:
                    done = True
                    continue
                v = np.asarray(batch.column(2)[k].values, dtype=np.float64)
                n = np.linalg.norm(v)
                v = v / (n if n > 0 else 1)
                if chosen and float((np.stack(chosen) @ v).max()) > alike:
                    continue
                chosen.append(v)
                picked.append((who, face))
                done = len(chosen) == most
            if picked:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*picked)], names=["person_id", "face_id"])

    dealt = rows.repartition("person_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "person_id long, face_id long")


def refresh_galleries(lib: Library, config: EngineConfig, persons: DataFrame | None = None) -> Library:
    """Representatives and adaptive thresholds of some persons (id), or of all, chosen anew from their galleries."""
    mine = lib.person_embeddings
    if persons is not None:
        mine = mine.join(persons.select(F.col("id").alias("person_id")), "person_id", "left_semi")
    # Python chooses once; both tables below read what it chose.
    chosen = cut(representatives(mine, config).withColumn("_rep", F.lit(True)))
    touched = persons.select(F.col("id").alias("person_id")).distinct() if persons is not None else lib.persons.select(
        F.col("id").alias("person_id")
    )
    gallery = (
        lib.person_embeddings.join(chosen, ["person_id", "face_id"], "left")
        .join(touched.withColumn("_touched", F.lit(True)), "person_id", "left")
        .select(
            "person_id",
            "face_id",
            "embedding",
            "quality",
            F.when(F.col("_touched"), F.coalesce("_rep", F.lit(False))).otherwise(F.col("is_representative")).alias(
                "is_representative"
            ),
        )
    )
    own = gallery_thresholds(gallery, config)
    fresh = touched.select(F.col("person_id").alias("id")).join(own.withColumnRenamed("person_id", "id"), "id", "left")
    flags = gallery.join(touched, "person_id", "left_semi").select("face_id", "is_representative")
    return lib.changed("person_embeddings", patch=flags).changed(
        "persons", patch=fresh.select("id", F.col("threshold").alias("adaptive_threshold"))
    )


def gallery_thresholds(gallery: DataFrame, config: EngineConfig) -> DataFrame:
    """(person_id, consistency, n, threshold) from the representatives of each gallery."""
    spread = consistency(gallery.filter("is_representative"), ["person_id"])
    return spread.select(
        "person_id", "consistency", "n", adaptive_threshold(F.col("consistency"), F.col("n"), config).alias("threshold")
    )


def persons_missing_gallery(lib: Library) -> DataFrame:
    """Persons with faces and without a gallery."""
    with_faces = lib.faces.filter(F.col("person_id").isNotNull()).select(F.col("person_id").alias("id")).distinct()
    return with_faces.join(lib.person_embeddings.select(F.col("person_id").alias("id")), "id", "left_anti")


def store_faces(lib: Library, faces: DataFrame, config: EngineConfig, ensure_one: bool) -> Library:
    """Add faces (person_id, id, embedding, det_score, boxes) to galleries; a face already stored takes the new row."""
    new = gallery_candidates(with_quality(faces), config, ensure_one).select(
        "person_id", F.col("id").alias("face_id"), "embedding", "quality", F.lit(False).alias("is_representative")
    )
    return lib.changed("person_embeddings", put=new)


def backfill_galleries(lib: Library, config: EngineConfig) -> Library:
    """A gallery for each person that has faces and none yet."""
    missing = persons_missing_gallery(lib)
    faces = lib.faces.join(missing.select(F.col("id").alias("person_id")), "person_id", "left_semi")
    return refresh_galleries(store_faces(lib, faces, config, ensure_one=True), config, missing)


def match_vectors(lib: Library, config: EngineConfig) -> DataFrame:
    """(person_id, vector, threshold, from_gallery): representatives and the centroid of each person.

    A person without representatives is matched by the centroid at the global threshold.
    """
    reps = lib.person_embeddings.filter("is_representative").select(
        "person_id", l2_normalize(F.col("embedding")).alias("vector")
    )
    has = reps.select("person_id").distinct().withColumn("from_gallery", F.lit(True))
    persons = lib.persons.select(F.col("id").alias("person_id"), "adaptive_threshold", "centroid")
    centroids = persons.filter(F.col("centroid").isNotNull()).select("person_id", l2_normalize(F.col("centroid")).alias("vector"))
    g = F.lit(config.face_match_threshold)
    return (
        reps.unionByName(centroids)
        .join(persons.select("person_id", "adaptive_threshold"), "person_id")
        .join(has, "person_id", "left")
        .select(
            "person_id",
            "vector",
            F.when(F.col("from_gallery"), F.coalesce("adaptive_threshold", g)).otherwise(g).alias("threshold"),
            F.coalesce("from_gallery", F.lit(False)).alias("from_gallery"),
        )
    )


def best_scores(faces: DataFrame, vectors: DataFrame, least: float = -1.0) -> DataFrame:
    """(face_id, person_id, score): each face's best cosine with each person's vectors, where it is at least `least`.

    Faces (face_id, vector) and vectors (person_id, vector), all of length 1, meet in blocks that may hold such a cosine;
    each pair of blocks is one matrix product in Arrow batches, and only scores over the floor come out.
    """

    def product(f_ids, _, f, p_ids, __, p, ___):
        order = np.argsort(p_ids, kind="stable")
        p_ids, p = p_ids[order], p[order]
        first = np.flatnonzero(np.concatenate([[True], p_ids[1:] != p_ids[:-1]]))
        top = np.maximum.reduceat(f @ p.T, first, axis=1)
        i, j = np.nonzero(top >= least)
        return pd.DataFrame({"face_id": f_ids[i], "person_id": p_ids[first][j], "score": top[i, j]})

    side = lambda rows, key: rows.select(F.col(key).alias("id"), F.lit(0).cast("long").alias("label"), "vector")
    found = near_products(
        side(faces, "face_id"), side(vectors, "person_id"), least, product, "face_id long, person_id long, score double"
    )
    return found.groupBy("face_id", "person_id").agg(F.max("score").alias("score"))


def person_contexts(lib: Library) -> tuple[DataFrame, DataFrame]:
    """Days and grid cells, with neighbours, of each person's photos: (person_id, day) and (person_id, cell)."""
    seen = (
        lib.faces.filter(F.col("person_id").isNotNull())
        .select("person_id", F.col("photo_id").alias("id"))
        .join(lib.photos.select("id", "taken_at", "gps_latitude", "gps_longitude"), "id")
        .select("person_id", F.to_date("taken_at").alias("day"), gps_cell(F.col("gps_latitude"), F.col("gps_longitude")).alias("cell"))
        .distinct()
    )
    days = seen.filter(F.col("day").isNotNull()).select("person_id", "day").distinct()
    cells = (
        seen.filter(F.col("cell").isNotNull())
        .select("person_id", F.explode(neighbour_cells(F.col("cell"))).alias("cell"))
        .distinct()
    )
    return days, cells


def with_context(lib: Library, scores: DataFrame) -> DataFrame:
    """scores (face_id, person_id, ...) plus context: day and place shared by the face's photo and the person's photos."""
    days, cells = person_contexts(lib)
    photos = lib.faces.select(F.col("id").alias("face_id"), F.col("photo_id").alias("id")).join(
        lib.photos.select(
            "id", F.to_date("taken_at").alias("day"), gps_cell(F.col("gps_latitude"), F.col("gps_longitude")).alias("cell")
        ),
        "id",
    ).drop("id")
    return (
        scores.join(photos, "face_id", "left")
        .join(days.withColumn("_d", F.lit(True)), ["person_id", "day"], "left")
        .join(cells.withColumn("_c", F.lit(True)), ["person_id", "cell"], "left")
        .withColumn(
            "context",
            context_score(
                F.col("day").isNotNull(), F.coalesce("_d", F.lit(False)), F.col("cell").isNotNull(), F.coalesce("_c", F.lit(False))
            ),
        )
        .drop("day", "cell", "_d", "_c")
    )


def match_faces(lib: Library, config: EngineConfig) -> DataFrame:
    """For each ungrouped face with a candidate in reach: face_id, person_id, score, verdict (assign or suggest).

    The score is the best cosine with a person's vectors, plus the context boost if it is within reach of the
    threshold; rejected pairs are out.  The best score at or over its person's threshold is assigned; on
    equal scores persons with representatives come first, then the lesser id.  A face without one is suggested the
    person whose threshold it misses least, within the margin.
    """
    vectors = match_vectors(lib, config)
    persons = vectors.groupBy("person_id").agg(F.first("threshold").alias("threshold"), F.max("from_gallery").alias("from_gallery"))
    faces = lib.faces.filter(F.col("person_id").isNull()).select(
        F.col("id").alias("face_id"), l2_normalize(F.col("embedding")).alias("vector")
    )
    # Below this no boost lifts a score into the margin of any threshold.
    least = min(config.adaptive_threshold_min, config.face_match_threshold) - config.context_reach - config.suggestion_margin
    scores = best_scores(faces, vectors, max(-1.0, least - 1e-9))
    rejected = lib.recognition_feedback.filter("verdict = 'reject'").select("face_id", "person_id")
    scores = scores.join(rejected, ["face_id", "person_id"], "left_anti").join(persons, "person_id")
    near = scores.filter(F.col("score") >= F.col("threshold") - config.context_reach)
    far = scores.filter(F.col("score") < F.col("threshold") - config.context_reach)
    boosted = with_context(lib, near).withColumn("score", F.col("score") + config.context_boost * F.col("context")).drop("context")
    return decide(boosted.unionByName(far), config)


def decide(scores: DataFrame, config: EngineConfig) -> DataFrame:
    """Assignment or suggestion for each face from (face_id, person_id, score, threshold, from_gallery)."""
    tie = (F.col("from_gallery").desc(), F.col("person_id").asc())
    by_score = Window.partitionBy("face_id").orderBy(F.desc("good"), F.desc("score"), *tie)
    by_gap = Window.partitionBy("face_id").orderBy(F.desc("gap"), *tie)
    rows = (
        scores.withColumn("gap", F.col("score") - F.col("threshold"))
        .withColumn("good", (F.col("gap") >= 0).cast("int"))
        .withColumns({"_s": F.row_number().over(by_score), "_g": F.row_number().over(by_gap)})
        .withColumn("_any", F.max("good").over(Window.partitionBy("face_id")))
    )
    assign = (F.col("_any") == 1) & (F.col("_s") == 1)
    suggest = (F.col("_any") == 0) & (F.col("_g") == 1) & (F.col("gap") >= -config.suggestion_margin)
    return rows.filter(assign | suggest).select(
        "face_id", "person_id", "score", F.when(assign, "assign").otherwise("suggest").alias("verdict")
    )


def assign_to_existing(lib: Library, config: EngineConfig) -> tuple[Library, DataFrame]:
    """Apply match_faces(): persons, galleries, centroids and suggestions; returns the library and the decisions."""
    found = cut(match_faces(lib, config))
    given = found.filter("verdict = 'assign'").select(F.col("face_id").alias("id"), F.col("person_id").alias("_new"))
    taken = lib.faces.join(given, "id").withColumn("person_id", F.col("_new")).drop("_new")
    unit = taken.select("person_id", F.posexplode(l2_normalize(F.col("embedding"))).alias("pos", "x"))
    sums = (
        unit.groupBy("person_id", "pos").agg(F.sum("x").alias("x")).groupBy("person_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("_sum"))
        .join(taken.groupBy("person_id").agg(F.count(F.lit(1)).cast("int").alias("_k")), "person_id")
    )
    n = F.coalesce("face_count", F.lit(0))
    blended = F.when(F.col("centroid").isNull(), l2_normalize(F.col("_sum"))).otherwise(
        running_centroid(F.col("centroid"), n, F.col("_sum"))
    )
    persons = lib.persons.join(sums.withColumnRenamed("person_id", "id"), "id").select(
        "id", blended.cast("array<float>").alias("centroid"), (n + F.col("_k")).cast("int").alias("face_count")
    )
    suggested = found.filter("verdict = 'suggest'").select("face_id", "person_id", "score")
    lib = lib.changed("faces", patch=given.withColumnRenamed("_new", "person_id")).changed("persons", patch=persons)
    lib = settled(lib.changed("recognition_suggestions", put=suggested), "persons")
    lib = settled(store_faces(lib, taken, config, ensure_one=False), "person_embeddings")
    return refresh_galleries(lib, config, taken.select(F.col("person_id").alias("id")).distinct()), found


def drop_stale_suggestions(lib: Library) -> Library:
    """Without suggestions for faces that have a person now."""
    grouped = lib.faces.filter(F.col("person_id").isNotNull()).select(F.col("id").alias("face_id"))
    return lib.changed("recognition_suggestions", drop=grouped)


def person_centroids(faces: DataFrame, normalize_rows: bool = True) -> DataFrame:
    """(person_id, centroid) of grouped faces: the mean of normalised rows, or of raw ones as recomputed profiles use."""
    return mean_vector(faces.filter(F.col("person_id").isNotNull()), ["person_id"], normalize_rows=normalize_rows)


def cover_faces(faces: DataFrame) -> DataFrame:
    """(person_id, cover_face_id): the face with the highest detector score, the lesser id on a tie."""
    score = F.coalesce("det_score", F.lit(0.0))
    return (
        faces.filter(F.col("person_id").isNotNull())
        .groupBy("person_id")
        .agg(F.max_by("id", F.struct(score, -F.col("id"))).alias("cover_face_id"))
    )


def similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors of length 1."""
    return dot(a, b)


def update_people(lib: Library, config: EngineConfig) -> tuple[Library, dict[str, int]]:
    """One incremental run: backfill, match, cluster the rest, drop stale suggestions, scan for merges.

    Without an ungrouped face it stops after the backfill, before the merge scan.
    """
    from .clustering import found_people
    from .merging import scan_for_merges

    lib = settled(backfill_galleries(settled(lib, "photos", "faces", "persons", "person_embeddings"), config), "persons", "person_embeddings")
    if not lib.faces.filter(F.col("person_id").isNull()).limit(1).count():
        return lib, {"assigned": 0, "suggested": 0, "founded": 0, "merged": 0, "merge_suggestions": 0}
    lib, found = assign_to_existing(lib, config)
    lib = settled(lib, "faces", "persons", "person_embeddings", "recognition_suggestions")
    tally = {r["verdict"]: r["n"] for r in found.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).collect()}
    before = lib.persons.count()
    lib = settled(drop_stale_suggestions(found_people(lib, config)), "faces", "persons", "person_embeddings", "recognition_suggestions")
    founded = lib.persons.count() - before
    lib, merged, suggested = scan_for_merges(lib, config)
    return lib, {
        "assigned": tally.get("assign", 0),
        "suggested": tally.get("suggest", 0),
        "founded": founded,
        "merged": merged,
        "merge_suggestions": suggested,
    }
