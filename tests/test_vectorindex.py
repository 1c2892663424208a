"""Exact vector search through cells against scans of all vectors."""

from datetime import datetime

import numpy as np
import pytest

from mediaspark.operators import mutations, search
from mediaspark.plans.library import load
from mediaspark.schemas import SCHEMAS, Library
from mediaspark.sources import vectorindex
from mediaspark.sources.snapshots import optimize_after_import, read_snapshot, write_snapshot

N, D = 6_000, 24


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, D))
    v = centres[rng.integers(0, 60, N)] + rng.normal(scale=0.15, size=(N, D))
    v[:5] = 0
    v[5:200] = rng.normal(size=(195, D))
    v[200:260] = v[300]  # ties
    return (v * rng.uniform(0.5, 3, (N, 1))).astype(np.float32)


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory, vectors):
    root = str(tmp_path_factory.mktemp("vectors") / "state")
    rows = [(i, x.tolist(), "m1", 1) for i, x in enumerate(vectors)] + [(N + i, [float(i), 1.0, 2.0], "m2", 1) for i in range(50)]
    clip = spark.createDataFrame(rows, SCHEMAS["clip_embeddings"])
    write_snapshot(Library.empty(spark).with_tables(clip_embeddings=clip.repartition(5)), root)
    return root


def plain(lib):
    lib.part("clip_embeddings").index = None
    return lib


def got(df):
    return [(r["photo_id"], round(r["similarity"], 9)) for r in df.collect()]


@pytest.mark.parametrize("limit", [1, 10, 80, 7_000])
def test_nearest_equals_a_scan(spark, root, vectors, limit):
    lib, whole = read_snapshot(spark, root), plain(read_snapshot(spark, root))
    assert lib.part("clip_embeddings").index
    rng = np.random.default_rng(limit)
    for query in (vectors[300], vectors[50], rng.normal(size=D), -vectors[400]):
        q = [float(x) for x in query]
        assert got(search.nearest(lib, q, "m1", limit)) == got(search.nearest(whole, q, "m1", limit))


def test_other_models_and_bad_queries(spark, root):
    lib, whole = read_snapshot(spark, root), plain(read_snapshot(spark, root))
    for q, model in (([1.0, 2.0, 3.0], "m2"), ([0.0] * D, "m1")):
        assert got(search.nearest(lib, q, model, 5)) == got(search.nearest(whole, q, model, 5))


def test_few_cells_are_read(spark, root, vectors, monkeypatch):
    """On clustered vectors under 20 % of the cells."""
    asked = []
    only = vectorindex._only
    monkeypatch.setattr(vectorindex, "_only", lambda lib, cells: asked.append(len(cells)) or only(lib, cells))
    lib = read_snapshot(spark, root)
    cells = lib.part("clip_embeddings").index[0].count()
    for i in range(1_000, 1_010):
        search.nearest(lib, [float(x) for x in vectors[i]], "m1", 10)
        assert asked[-1] < 0.2 * cells
    assert cells > 50


def test_changes_and_filters(spark, tmp_path):
    """Filters come before the top-k, and changed vectors are found, before and after they are saved."""
    lib = load(spark, "/root/testdata/sf0.01")
    root = str(tmp_path / "state")
    write_snapshot(lib, root)
    saved, whole = read_snapshot(spark, root), plain(read_snapshot(spark, root))
    q = [float(x) for x in lib.clip_embeddings.filter("photo_id = 7").first()["embedding"]]
    for limit in (3, 20, 400):
        filters = dict(favorite=True, since=datetime(1995, 1, 1), person_id=2)
        assert got(search.nearest(saved, q, "m1", limit, **filters)) == got(search.nearest(whole, q, "m1", limit, **filters))
    rows = spark.createDataFrame([(3, [-x for x in q], "m1", 1), (11, q, "m1", 1), (8, q, "m9", 1)], SCHEMAS["clip_embeddings"])
    new = mutations.upsert_clip(saved, rows)
    want = got(search.nearest(mutations.upsert_clip(whole, rows), q, "m1", 5))
    assert got(search.nearest(new, q, "m1", 5)) == want and 11 in {i for i, _ in want}
    write_snapshot(new, root)
    assert got(search.nearest(read_snapshot(spark, root), q, "m1", 5)) == want
    optimize_after_import(spark, root)
    assert got(search.nearest(read_snapshot(spark, root), q, "m1", 5)) == want


def test_too_few_vectors_have_no_cells(spark, tmp_path):
    root = str(tmp_path / "state")
    clip = spark.createDataFrame([(1, [1.0, 2.0], "m", 1)], SCHEMAS["clip_embeddings"])
    write_snapshot(Library.empty(spark).with_tables(clip_embeddings=clip), root)
    lib = read_snapshot(spark, root)
    assert lib.part("clip_embeddings").index is None and lib.clip_embeddings.count() == 1
    assert [r["photo_id"] for r in search.nearest(lib, [1.0, 0.0], "m", 3).collect()] == [1]
