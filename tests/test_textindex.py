"""Searches through the trigram index against scans of all photos."""

import os
import random

import pytest
from pyspark.sql import functions as F

from mediaspark.operators import browse, mutations
from mediaspark.plans.library import load
from mediaspark.schemas import SCHEMAS, Library
from mediaspark.sources import textindex
from mediaspark.sources.snapshots import optimize_after_import, read_snapshot, write_snapshot

N = 12_000


def photos_of(spark, texts):
    rows = [(i, f"/lib/Dir{i % 7}/p{i}.JPG", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, file_path string, ocr_text string").repartition(4, "id")
    return df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS["photos"].fields])


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvwyz") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    out = [" ".join(rng.choices(words, k=120)) for _ in range(N)]
    out[777] += " QXjümper 100%_sure"
    out[5] = None
    out[6] = ""
    out[7] = "ab"
    return out


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory, texts):
    root = str(tmp_path_factory.mktemp("text") / "state")
    write_snapshot(Library.empty(spark).with_tables(photos=photos_of(spark, texts)), root)
    return root


def found(lib, *tokens):
    return sorted(r["id"] for r in browse.photos_by_ocr(lib, tokens, 1_000_000).collect())


def scanned(texts, *tokens):
    return [i for i, t in enumerate(texts) if t and any(x.lower() in t.lower() for x in tokens)]


@pytest.mark.parametrize("tokens", [("qxj",), ("jüm",), ("JÜMPER",), ("qxjümper", "nowhere"), ("nowhere",), ("aba",), ("xqz", "the"), ("uvw", "vwy", "wyz")])
def test_searches_equal_scans(spark, root, texts, tokens):
    assert found(read_snapshot(spark, root), *tokens) == scanned(texts, *tokens)


def test_wildcards_and_short_tokens(spark, root, texts):
    lib = read_snapshot(spark, root)
    assert found(lib, "qx%sure") == [777] == found(lib, "Q_jü")
    assert found(lib, "ab") == []  # under three characters: dropped, as without an index
    assert found(lib, "a%b") == [i for i, t in enumerate(texts) if t and "a" in t and "b" in t[t.index("a") :]]
    assert textindex.narrowed(lib, ["a%b"]) is lib and textindex.narrowed(lib, []) is lib


def test_page_filter_of_names(spark, root):
    lib, plain = read_snapshot(spark, root), read_snapshot(spark, root)
    plain.part("photos").index = None
    for text in ("p1234.jpg", "dir3/P1", "DIR6", "none such", "p%9.j"):
        a, b = (sorted(r["id"] for r in browse.photo_grid(x, 50_000, search=text).collect()) for x in (lib, plain))
        assert a == b


def test_a_rare_token_reads_few_bytes(spark, root):
    """Under 5 % of the files, index and look-up together, in files as optimize_after_import() leaves them."""
    name = optimize_after_import(spark, root)
    lib = read_snapshot(spark, root)
    files = sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(f"{root}/{name}") for f in names if f.endswith(".parquet") and "photos" in d)
    store = spark.sparkContext._jsc.sc().statusStore()
    # What other threads read ahead is not counted, and what a buffer reads beyond a page is.
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    buffer = conf.get("io.file.buffer.size")
    conf.set("parquet.hadoop.vectored.io.enabled", "false")
    conf.set("io.file.buffer.size", "4096")

    def read():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
        it, total = store.executorList(True).iterator(), 0
        while it.hasNext():
            total += it.next().totalInputBytes()
        return total

    start = read()
    assert found(lib, "qxjümper") == [777]
    rare = read() - start
    plain = read_snapshot(spark, root)
    plain.part("photos").index = None
    start = read()
    assert found(plain, "qxjümper") == [777]
    whole = read() - start
    conf.unset("parquet.hadoop.vectored.io.enabled")
    conf.set("io.file.buffer.size", buffer)
    assert rare < 0.05 * files and rare < 0.1 * whole


def test_changes_are_searched_too(spark, tmp_path, texts):
    root = str(tmp_path / "state")
    write_snapshot(Library.empty(spark).with_tables(photos=photos_of(spark, texts[:2000])), root)
    values = spark.createDataFrame([(3, "Qxjümper here"), (777, "gone")], "id long, value string")
    lib = mutations.set_photo_values(read_snapshot(spark, root), values, "ocr_text")
    assert found(lib, "qxjümper") == [3]  # before it is saved
    write_snapshot(lib, root)
    lib = read_snapshot(spark, root)
    assert len(lib.part("photos").changes) == 1 and lib.part("photos").index
    assert found(lib, "qxjümper") == [3] and found(lib, "gone") == [777]
    lib = mutations.set_photo_values(lib, spark.createDataFrame([(3, True)], "id long, value boolean"), "is_favorite")
    more = spark.createDataFrame([("/new/x.jpg", "h", "an Qxjümper too")], "file_path string, file_hash string, ocr_text string")
    from datetime import datetime

    write_snapshot(mutations.insert_photos(lib, more, datetime(2024, 1, 1)), root)
    lib = read_snapshot(spark, root)
    assert found(lib, "qxjümper") == [3, 2000]
    assert [r["id"] for r in browse.photos_by_ocr(lib, ["qxjümper"], 9, favorite=True).collect()] == [3]


def test_given_tables_through_a_snapshot(spark, tmp_path):
    """The registered searches, over the given tables and over their snapshot."""
    lib = load(spark, "/root/testdata/sf0.01")
    root = str(tmp_path / "state")
    write_snapshot(lib, root)
    saved = read_snapshot(spark, root)
    for tokens in (["the", "zzz"], ["tion"], ["äge"], ["ing", "xyz"]):
        assert found(saved, *tokens) == found(lib, *tokens)


def test_ranges_cover_all_chunks(spark):
    rng = random.Random(1)
    for n in (1, 2, 31, 32, 33, 500):
        chunks = sorted(rng.sample(range(10_000), n))
        kept = {r["_chunk"] for r in spark.range(10_000).withColumnRenamed("id", "_chunk").filter(textindex._ranges(chunks)).collect()}
        assert set(chunks) <= kept and (n > textindex.RANGES or kept == set(chunks))
