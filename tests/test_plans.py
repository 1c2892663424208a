"""Plans are the ones that scale: filters and columns reach the scan, top-k is per task, no cross join where none is meant."""

import pytest

from mediaspark.operators import browse, duplicates, search, stats
from mediaspark.plans.library import load
from mediaspark.sources.snapshots import read_snapshot, write_snapshot


@pytest.fixture(scope="module")
def lib(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("plans"))
    write_snapshot(load(spark, "/root/testdata/sf0.001"), root)
    return read_snapshot(spark, root)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().optimizedPlan().toString()


def test_month_range_reaches_the_scan(lib):
    text = plan(browse.photos_by_month(lib, 1997, 12))
    assert "GreaterThanOrEqual(taken_at" in text and "LessThan(taken_at" in text and "TakeOrderedAndProject" in text
    assert "ocr_text" not in text.split("ReadSchema")[1].split("\n")[0]


def test_nearest_reads_vectors_only(lib):
    spark = lib.photos.sparkSession
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")  # the cells' filters come before the model's
    text = plan(search.nearest(lib, [0.1] * 64, "m1", 10))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "TakeOrderedAndProject" in text and "EqualTo(model,m1)" in text and "Exchange" not in text.split("TakeOrderedAndProject")[1].split("Project [")[0]
    assert "version" not in text.split("ReadSchema")[1].split("\n")[0]


def test_person_filter_is_a_semi_join(lib):
    assert "LeftSemi" in plan(browse.photo_grid(lib, person_id=3))
    assert "LeftAnti" in plan(browse.pending_clip(lib, "m1", 1))


def test_no_vector_is_read_for_counts(lib):
    assert "embedding" not in plan(stats.appears_with(lib, 3)).split("ReadSchema")[1].split("\n")[0]


def test_bands_join_by_equality(lib):
    text = plan(duplicates.hamming_pairs(browse.hashed_photos(lib)))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
