"""Snapshots of changes: what a save writes, what is read back, and conflicts."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mediaspark.api import MediaLibrary
from mediaspark.operators import mutations
from mediaspark.plans.library import load
from mediaspark.schemas import KEYS, SCHEMAS, Library, Part
from mediaspark.sources import snapshots
from mediaspark.sources.deltas import Change, merged
from mediaspark.sources.snapshots import optimize_after_import, read_snapshot, version, write_snapshot

NOW = datetime(2024, 5, 6, 7, 8, 9)


def written(root):
    """Bytes of data in each folder below root, by name."""
    out = {}
    for d, _, files in os.walk(root):
        size = sum(os.path.getsize(f"{d}/{f}") for f in files if not f.startswith((".", "_SUCCESS")))
        if size:
            out[os.path.relpath(d, root)] = size
    return out


def rows(df):
    return sorted(map(str, df.collect()))


def equal(a, b, names=tuple(SCHEMAS)):
    assert names
    for name in names:
        assert rows(a[name]) == rows(b[name].select(*a[name].columns)), name


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("library") / "state")
    write_snapshot(load(spark, "/root/testdata/sf0.001"), root)
    return root


def test_a_favourite_writes_kilobytes(spark, tmp_path):
    """Many photos; one mark writes one small file and the manifest."""
    root = str(tmp_path / "state")
    photos = spark.range(300_000).select("id", F.concat(F.lit("/p"), "id").alias("file_path"), F.lit(False).alias("is_favorite"))
    columns = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in photos.columns else F.col(f.name) for f in SCHEMAS["photos"].fields]
    write_snapshot(Library.empty(spark).with_tables(photos=photos.select(*columns)), root)
    before = written(root)
    app = MediaLibrary(read_snapshot(spark, root))
    app.set_favorite(177_777, True)
    name = app.save(root)
    new = {d: n for d, n in written(root).items() if d not in before}
    assert set(new) == {name, f"{name}/photos.1"}  # the manifest, the change
    assert sum(new.values()) < 16_000
    lib = read_snapshot(spark, root)
    assert [r["id"] for r in lib.photos.filter("is_favorite").collect()] == [177_777]
    assert lib.photos.count() == 300_000


def test_unchanged_tables_are_carried_over(spark, saved):
    first = snapshots.current_snapshot(spark, saved)
    lib = read_snapshot(spark, saved)
    name = write_snapshot(mutations.rename_album(lib, 1, "renamed", NOW), saved, version(spark, saved))
    manifest = snapshots.read_manifest(spark, saved, name)
    old = snapshots.read_manifest(spark, saved, first)
    assert all(manifest[t] == old[t] for t in SCHEMAS if t != "albums")
    assert manifest["albums"]["base"] == old["albums"]["base"] and len(manifest["albums"]["changes"]) == 1
    assert read_snapshot(spark, saved).albums.filter("id = 1").first()["name"] == "renamed"
    assert read_snapshot(spark, saved, first).albums.filter("name = 'renamed'").count() == 0


def test_mutations_read_back_as_in_memory(spark, tmp_path):
    """Each mutation, saved as changes and merged on reading, is what it is in memory, over whole tables."""
    from mediaspark.config import EngineConfig

    root, config = str(tmp_path / "state"), EngineConfig()
    write_snapshot(load(spark, "/root/testdata/sf0.001"), root)
    one = lambda **c: spark.createDataFrame([tuple(c.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'long'}" for k, v in c.items()))
    faces = lambda lib, n: lib.faces.filter(F.col("id") < n).select(F.col("id").alias("face_id"))
    steps = [
        lambda lib: mutations.insert_photos(lib, one(file_path="/new/a.jpg", file_hash="h", file_size=5), NOW),
        lambda lib: mutations.delete_persons(lib, lib.persons.filter("id = 4").select("id")),
        lambda lib: mutations.delete_faces(lib, faces(lib, 9)),
        lambda lib: mutations.merge_persons(lib, 3, 5, config),
        lambda lib: mutations.reject_merge(lib, 3, 0),
        lambda lib: mutations.confirm_face(lib, 12, 5, config, NOW),
        lambda lib: mutations.remove_person_from_photos(lib, 5, [15, 16, 17], config, NOW),
        lambda lib: mutations.mark_duplicates(mutations.restore_duplicate(lib, 1), 2, [2, 9, 40]),
        lambda lib: mutations.add_to_album(mutations.delete_album(lib, 2), 4, [9, 2, 9, 14], NOW)[0],
        lambda lib: mutations.add_to_album(mutations.create_album(lib, "new", NOW)[0], 5, [3], NOW)[0],
        lambda lib: mutations.remove_from_album(lib, 4, [2, 3]),
        lambda lib: mutations.upsert_clip(lib, lib.clip_embeddings.limit(3).withColumn("model", F.lit("other"))),
        lambda lib: mutations.finish_scan_run(mutations.start_scan_run(lib, "/x", NOW)[0], 5, 1, 2, 3, 4, NOW),
        lambda lib: mutations.dismiss_group(lib, [4, 3]),
        mutations.reset_faces_processed,
    ]
    # Those that choose galleries anew are saved by themselves, for short plans.
    for group in (steps[:3], steps[3:4], steps[5:6], steps[6:7], steps[4:5] + steps[7:]):
        lib = read_snapshot(spark, root)
        whole = Library({n: lib[n] for n in SCHEMAS})  # the same tables, no snapshot behind them
        new = lib
        for step in group:
            new, whole = step(new), step(whole)
        write_snapshot(new, root, version(spark, root))
        got = read_snapshot(spark, root)
        assert not any(got.part(n).whole for n in SCHEMAS)
        # Other tables are the very files they were.
        equal(whole, got, [n for n in SCHEMAS if len(got.part(n).changes) > len(lib.part(n).changes)])
    # Nothing but changes was written since the first version.
    assert len([d for d in written(root) if d.endswith("/photos")]) == 1
    before = read_snapshot(spark, root)
    optimize_after_import(spark, root)
    after = read_snapshot(spark, root)
    assert all(not after.part(n).changes for n in SCHEMAS)
    equal(before, after)


def test_many_changes_are_folded(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "state")
    monkeypatch.setattr(snapshots, "FOLD", 3)
    write_snapshot(load(spark, "/root/testdata/sf0.001"), root)
    for i in range(5):
        write_snapshot(mutations.rename_album(read_snapshot(spark, root), i, f"album {i}", NOW), root)
    entry = snapshots.read_manifest(spark, root, snapshots.current_snapshot(spark, root))["albums"]
    assert len(entry["changes"]) == 1  # the fourth save wrote the table whole
    assert sorted(r["name"] for r in read_snapshot(spark, root).albums.collect()) == [f"album {i}" for i in range(5)]


def test_two_writers_of_changes_conflict(spark, tmp_path):
    root = str(tmp_path / "state")
    write_snapshot(load(spark, "/root/testdata/sf0.001"), root)
    a, b = MediaLibrary(read_snapshot(spark, root)), MediaLibrary(read_snapshot(spark, root))
    a.rename_person(1, "first")
    a.save(root)
    b.rename_person(2, "second")
    with pytest.raises(snapshots.Conflict):
        b.save(root)
    a.rename_person(2, "third")  # a goes on from its own save
    a.save(root)
    names = {r["id"]: r["display_name"] for r in read_snapshot(spark, root).persons.collect()}
    assert (names[1], names[2]) == ("first", "third")


def test_a_library_of_an_older_version_is_written_whole(spark, tmp_path):
    root = str(tmp_path / "state")
    write_snapshot(load(spark, "/root/testdata/sf0.001"), root)
    old = read_snapshot(spark, root)
    write_snapshot(mutations.rename_album(old, 0, "newer", NOW), root)
    write_snapshot(mutations.rename_album(old, 1, "own", NOW), root)  # no version given: the last writer's state holds
    names = {r["id"]: r["name"] for r in read_snapshot(spark, root).albums.collect()}
    assert names[1] == "own" and names[0] != "newer"


def test_snapshots_without_a_manifest_are_read(spark, tmp_path):
    root = str(tmp_path / "state")
    name = write_snapshot(load(spark, "/root/testdata/sf0.001"), root)
    photos = read_snapshot(spark, root).photos.count()
    os.remove(f"{root}/{name}/{snapshots.MANIFEST}")
    assert read_snapshot(spark, root).photos.count() == photos


def test_orders_of_changes(spark):
    """Later changes win, patches of missing keys pass, a key may come back after a drop."""
    schema, key = SCHEMAS["albums"], KEYS["albums"]

    def albums(*values):
        return spark.createDataFrame([(i, n, c, None, None) for i, n, c in values], schema)

    def patch(*values):
        return spark.createDataFrame(values, "id long, name string")

    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    changes = [
        ("patch", patch((1, "one"), (9, "passed"))),
        ("put", albums((2, "two", 20), (3, "three", 30))),
        ("patch", patch((2, None), (3, "THREE"))),
        ("drop", ids(3, 4)),
        ("append", albums((4, "again", 44), (9, "nine", 90))),
        ("patch", patch((4, "AGAIN"))),
        ("put", albums((5, "five", 50))),
        ("drop", ids(5, 77)),
    ]
    base = albums((1, "a", 1), (2, "b", 2), (3, "c", 3), (4, "d", 4), (6, "f", 6))
    for n in range(len(changes) + 1):
        state = {r["id"]: (r["name"], r["cover_photo_id"]) for r in base.collect()}
        for kind, df in changes[:n]:
            for r in df.collect():
                if kind in ("append", "put"):
                    state[r["id"]] = (r["name"], r["cover_photo_id"])
                elif kind == "drop":
                    state.pop(r["id"], None)
                elif r["id"] in state:
                    state[r["id"]] = (r["name"], state[r["id"]][1])
        got = merged(base, [Change(k, df, i + 1) for i, (k, df) in enumerate(changes[:n])], schema, key)
        assert {r["id"]: (r["name"], r["cover_photo_id"]) for r in got.collect()} == state, n
        assert got.columns == [f.name for f in schema.fields]


def test_changes_have_the_table_s_columns(spark):
    lib = Library.empty(spark)
    with pytest.raises(ValueError, match="unknown"):
        lib.changed("albums", patch=spark.createDataFrame([(1, 2)], "id long, other long"))
    with pytest.raises(ValueError, match="missing"):
        lib.changed("albums", drop=spark.createDataFrame([(1,)], "name long"))
    with pytest.raises(KeyError):
        Library({"nothing": Part(lib.albums)})


def test_filters_reach_the_scan_through_changes(spark, saved):
    """A filter on a column that no patch sets is pushed down to the base rows."""
    root = saved
    write_snapshot(mutations.set_photo_values(read_snapshot(spark, root), spark.createDataFrame([(3, True)], "id long, value boolean"), "is_favorite"), root)
    plan = read_snapshot(spark, root).photos.filter("width > 500").select("id", "is_favorite")._jdf.queryExecution().toString()
    assert "GreaterThan(width,500)" in plan
    assert "ReadSchema: struct<id:bigint,width:int,is_favorite:boolean>" in plan
