"""Representatives, merge folds and clusters as jobs against their plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaspark.config import EngineConfig
from mediaspark.operators import clustering, merging, recognition
from mediaspark.operators.graph import components
from mediaspark.plans.library import load

C = EngineConfig()


def gallery(spark, rows):
    return spark.createDataFrame(rows, "person_id long, face_id long, embedding array<float>, quality double").repartition(4)


def plain_choice(rows, config):
    out = set()
    for person in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == person), key=lambda r: -r[1])
        v = np.array([r[2] for r in mine], np.float32).astype(float)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        picked = recognition.choose_representatives(v / np.where(n > 0, n, 1), np.array([r[3] for r in mine]), config)
        out |= {(person, mine[i][1]) for i in picked}
    return out


@pytest.mark.parametrize("most", [1, 4, 8])
def test_streamed_representatives_equal_the_plain_choice(spark, most):
    """Ties, weak faces only, zero vectors, persons of one face, near and far faces."""
    rng = np.random.default_rng(most)
    rows, face = [], 0
    for person in range(30):
        centres = rng.normal(size=(rng.integers(1, 6), 6))
        for _ in range(int(rng.choice([1, 2, 40]))):
            v = centres[rng.integers(len(centres))] + rng.normal(scale=0.2, size=6) if rng.random() < 0.95 else np.zeros(6)
            quality = float(rng.choice([0.2, 0.4, 0.6, 0.8])) if person % 5 else 0.1
            rows.append((person, face, [float(np.float32(x)) for x in v], quality))
            face += 1
    config = EngineConfig(person_max_representatives=most)
    got = {tuple(r) for r in recognition.representatives(gallery(spark, rows), config).collect()}
    assert got == plain_choice(rows, config)


def test_a_person_of_very_many_faces_is_streamed(spark):
    """One person of 200,000 faces; what a task holds are the chosen few."""
    n = 200_000
    v = F.array(*[F.cos(F.col("id") * (k + 1)).cast("float") for k in range(4)])
    rows = spark.range(n).select(F.lit(1).cast("long").alias("person_id"), F.col("id").alias("face_id"), v.alias("embedding"), (F.col("id") % 97 / 97.0).alias("quality"))
    got = recognition.representatives(rows, C).collect()
    assert 1 <= len(got) <= C.person_max_representatives
    best = rows.filter("face_id % 97 = 96").agg(F.max("face_id")).first()[0]
    assert (1, best) in {tuple(r) for r in got}


def test_candidates_keep_each_person_s_best(spark):
    faces = load(spark, "/root/testdata/sf0.001").faces.filter("person_id is not null")
    got = {r["id"] for r in recognition.gallery_candidates(faces, EngineConfig(face_quality_store_min=0.9)).collect()}
    want, best = set(), {}
    for r in recognition.with_quality(faces).collect():
        if r["quality"] >= 0.9:
            want.add(r["id"])
        best[r["person_id"]] = max(best.get(r["person_id"], (-1, 0)), (r["quality"], -r["id"]))
    assert got == want | {-i for _, i in best.values()}


@pytest.mark.parametrize("seed", range(4))
def test_merges_by_component_equal_the_fold(spark, seed):
    """Random graphs of candidates: survivors, and what is left to suggest."""
    rng = random.Random(seed)
    names = {p: rng.choice([None, None, None, f"n{p}"]) for p in range(40)}
    sizes = {p: rng.choice([None, 1, 2, 2, 5]) for p in range(40)}
    pairs = []
    for _ in range(90):
        a, b = sorted(rng.sample(range(40), 2))
        if (a, b) not in {p[:2] for p in pairs}:
            pairs.append((a, b, rng.choice([0.5, 0.6, 0.7, 0.8, 0.9]), names[a], names[b], sizes[a], sizes[b]))
    df = spark.createDataFrame(pairs, "person_a long, person_b long, score double, name_a string, name_b string, size_a int, size_b int").repartition(3)
    merges, _ = merging.fold_merges(pairs, set(), 0.7)
    alias = dict(merges)

    def final(p):
        while p in alias:
            p = alias[p]
        return p

    got = {tuple(r) for r in merging.merge_survivors(df, 0.7).collect()}
    assert got == {(p, final(p)) for p in alias} and got


def test_scan_for_merges_equals_the_fold(spark):
    """Whole runs on the given tables, with low thresholds: persons, suggestions and rejections."""
    config = EngineConfig(merge_suggest_threshold=0.1, merge_auto_threshold=0.2)
    lib = load(spark, "/root/testdata/sf0.001")
    columns = ("person_a", "person_b", "score", "name_a", "name_b", "size_a", "size_b")
    pairs = [tuple(r) for r in merging.merge_candidates(lib, config).select(*columns).collect()]
    rejected = {tuple(r) for r in lib.person_merge_rejections.select("person_a", "person_b").collect()}
    merges, open_ = merging.fold_merges(pairs, rejected, 0.2)
    out, merged, suggested = merging.scan_for_merges(lib, config)
    assert (merged, suggested) == (len(merges), len(open_)) and merged and suggested
    got = {(r["person_a"], r["person_b"]): r["score"] for r in out.person_merge_suggestions.collect()}
    assert got == {(a, b): pytest.approx(s) for a, b, s in open_}
    gone = {s for s, _ in merges}
    assert {r["id"] for r in out.persons.collect()} == {r["id"] for r in lib.persons.collect()} - gone


def test_recluster_founds_a_person_for_each_cluster(spark):
    """All persons are forgotten, and each cluster of a plain DBSCAN becomes one, in the order of its least face."""
    lib = load(spark, "/root/testdata/sf0.001")
    config = EngineConfig(cluster_eps=0.64)
    faces = sorted((r["id"], r["embedding"]) for r in lib.faces.select("id", "embedding").collect())
    v = np.array([e for _, e in faces], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= 1 - config.cluster_eps - 1e-12
    core = near.sum(1) >= config.cluster_min_samples
    edges = [(faces[i][0], faces[j][0]) for i, j in zip(*np.nonzero(near)) if core[i] and core[j] and i < j]
    named = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {}
    for i, (face, _) in enumerate(faces):
        reach = [named.get(faces[j][0], faces[j][0]) for j in np.flatnonzero(near[i] & core)]
        label[face] = named.get(face, face) if core[i] else min(reach, default=None)
    out = clustering.recluster(lib, config)
    person = {r["id"]: r["person_id"] for r in out.faces.collect()}
    clusters = sorted({c for c in label.values() if c is not None})
    assert person == {f: clusters.index(c) + 1 if c is not None else None for f, c in label.items()}
    counts = {r["id"]: r["face_count"] for r in out.persons.collect()}
    assert counts == {k + 1: sum(c == x for x in label.values()) for k, c in enumerate(clusters)}
    assert out.person_embeddings.count() == 0
