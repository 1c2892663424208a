import random
import struct
import zlib
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mediaspark.config import EngineConfig
from mediaspark.functions import scalars
from mediaspark.operators import browse, clustering, duplicates, knowledge, merging, mutations, products, recognition, search, stats
from mediaspark.operators.graph import components
from mediaspark.plans import registry
from mediaspark.plans.library import load
from mediaspark.plans.pipeline import ImportRun, default_steps, make_thumbnails
from mediaspark.schemas import SCHEMAS, Library
from mediaspark.sources import images, snapshots
from mediaspark.sources.snapshots import read_snapshot, write_snapshot
from mediaspark.streaming.ingest import scan, scan_directory, watch

NOW = datetime(2024, 6, 1)
C = EngineConfig(cluster_min_samples=2)


def rows(spark, table, *values):
    """Rows of a table from dicts; columns left out are null."""
    schema = SCHEMAS[table]
    return spark.createDataFrame([tuple(v.get(f.name) for f in schema.fields) for v in values], schema)


def face(i, photo, vector, person=None, score=0.9, box=120):
    return dict(id=i, photo_id=photo, bbox_x=0, bbox_y=0, bbox_w=box, bbox_h=box, det_score=score, person_id=person, embedding=[float(x) for x in vector])


def photo(i, **more):
    return dict(id=i, file_path=f"/p{i}.jpg", file_hash=f"h{i}", file_size=i, is_favorite=False, faces_processed=True) | more


def unit(i, n=8):
    return np.eye(n)[i]


def at(cos, base, other):
    """A vector with this cosine to `base`."""
    return cos * base + np.sqrt(1 - cos * cos) * other


@pytest.fixture
def lib(spark):
    return Library.empty(spark).with_tables(photos=rows(spark, "photos", *[photo(i) for i in range(1, 31)]))


def test_dbscan_finds_three_clusters(spark):
    rng = np.random.default_rng(0)
    centres = [v / np.linalg.norm(v) for v in rng.normal(size=(5, 64))]
    points = [c + rng.normal(0, 0.01, 64) for c in centres[:3] for _ in range(4)] + centres[3:]
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, embedding array<float>")
    got = {r.id: r.cluster for r in clustering.dbscan(df, 0.35, 2).collect()}
    assert [got[i] for i in range(14)] == [0] * 4 + [4] * 4 + [8] * 4 + [-1, -1]


def brute_dbscan(v, eps, least):
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= 1 - eps
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(v)), -1)
    for _ in range(len(v)):
        for i in np.flatnonzero(core):
            label[i] = label[np.flatnonzero(near[i] & core)].min()
    out = label.copy()
    for i in np.flatnonzero(~core):
        reach = np.flatnonzero(near[i] & core)
        if len(reach):
            out[i] = label[reach].min()
    return out


def test_dbscan_equals_brute_force(spark):
    v = np.random.default_rng(1).normal(size=(80, 4))
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(v.astype(np.float32))], "id long, embedding array<float>")
    got = {r.id: r.cluster for r in clustering.dbscan(df, 0.1, 4).collect()}
    want = brute_dbscan(v.astype(np.float32).astype(float), 0.1, 4)
    assert [got[i] for i in range(80)] == want.tolist()


def test_representatives():
    v = np.array([[1, 0, 0, 0], [1, 0.05, 0, 0], [1, 0.1, 0, 0], [0, 1, 0, 0]], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert sorted(recognition.choose_representatives(v, np.array([0.8, 0.95, 0.85, 0.9]), C)) == [1, 3]
    many = EngineConfig(person_max_representatives=3)
    assert len(recognition.choose_representatives(np.eye(6), np.full(6, 0.9), many)) == 3
    assert recognition.choose_representatives(np.eye(4), np.array([0.2, 0.4, 0.3, 0.1]), C) == [1]


def known_person(lib, spark, **photo_more):
    person = rows(spark, "persons", dict(id=1, display_name="Ann", face_count=1, cover_face_id=1, centroid=[float(x) for x in unit(0)]))
    gallery = rows(spark, "person_embeddings", dict(person_id=1, face_id=1, embedding=[float(x) for x in unit(0)], quality=1.0, is_representative=True))
    photos = rows(spark, "photos", photo(1, **photo_more), photo(2, **photo_more))
    return lib.with_tables(persons=person, person_embeddings=gallery, photos=photos)


def test_near_miss_is_suggested_and_context_lifts_it(spark, lib):
    faces = rows(spark, "faces", face(1, 1, unit(0), 1), face(2, 2, at(0.52, unit(0), unit(1))))
    found = recognition.match_faces(known_person(lib, spark).with_tables(faces=faces), C).collect()
    assert [(r.face_id, r.person_id, r.verdict) for r in found] == [(2, 1, "suggest")]
    here = dict(taken_at=datetime(2020, 5, 1), gps_latitude=37.0, gps_longitude=-122.0)
    found = recognition.match_faces(known_person(lib, spark, **here).with_tables(faces=faces), C).collect()
    assert [(r.face_id, r.verdict) for r in found] == [(2, "assign")] and found[0].score == pytest.approx(0.58, abs=1e-6)
    rejected = rows(spark, "recognition_feedback", dict(face_id=2, person_id=1, verdict="reject", created_at=NOW))
    blocked = known_person(lib, spark, **here).with_tables(faces=faces, recognition_feedback=rejected)
    assert recognition.match_faces(blocked, C).count() == 0


def test_update_run_assigns_founds_and_learns(spark, lib):
    faces = rows(
        spark, "faces", face(1, 1, unit(0), 1), face(2, 2, at(0.9, unit(0), unit(1))), face(3, 3, unit(3)), face(4, 4, at(0.99, unit(3), unit(4))),
        face(5, 5, unit(6), score=0.2, box=20),
    )
    out, report = recognition.update_people(known_person(lib, spark).with_tables(faces=faces), C)
    people = {r.id: r.person_id for r in out.faces.collect()}
    assert people == {1: 1, 2: 1, 3: 2, 4: 2, 5: None} and report["assigned"] == 1 and report["founded"] == 1
    persons = {r.id: r for r in out.persons.collect()}
    assert persons[1].face_count == 2 and persons[2].face_count == 2
    assert out.person_embeddings.filter("person_id = 2 and is_representative").count() >= 1
    assert recognition.update_people(out.with_tables(faces=out.faces.filter("person_id is not null")), C)[1]["assigned"] == 0


def merging_lib(spark, lib, cos, name=None):
    persons = rows(
        spark, "persons", dict(id=1, display_name=name, face_count=3, centroid=[float(x) for x in unit(0)]),
        dict(id=2, face_count=4, centroid=[float(x) for x in at(cos, unit(0), unit(1))]),
    )
    faces = rows(spark, "faces", *[face(i, i, unit(0), 1) for i in (1, 2, 3)], *[face(i, i, at(cos, unit(0), unit(1)), 2) for i in (4, 5, 6, 7)])
    return lib.with_tables(persons=persons, faces=faces)


def test_merge_scan(spark, lib):
    out, merged, open_ = merging.scan_for_merges(merging_lib(spark, lib, 0.6), C)
    assert (merged, open_) == (0, 1) and out.person_merge_suggestions.first().score == pytest.approx(0.6)
    out, merged, open_ = merging.scan_for_merges(merging_lib(spark, lib, 0.85), C)
    assert (merged, open_) == (1, 0) and [(r.id, r.face_count) for r in out.persons.collect()] == [(2, 7)]
    assert merging.scan_for_merges(merging_lib(spark, lib, 0.85, "Ann"), C)[1:] == (0, 1)
    no = merging_lib(spark, lib, 0.85).with_tables(person_merge_rejections=rows(spark, "person_merge_rejections", dict(person_a=1, person_b=2)))
    assert merging.scan_for_merges(no, C)[1:] == (0, 0)


def test_fold_follows_aliases():
    pairs = [(1, 2, 0.9, None, None, 3, 4), (2, 3, 0.8, None, None, 4, 5), (1, 3, 0.6, None, None, 3, 5), (3, 4, 0.55, None, "D", 5, 1)]
    merges, open_ = merging.fold_merges(pairs, set(), 0.7)
    assert merges == [(1, 2), (3, 2)] and open_ == [(2, 4, 0.55)]


def test_duplicates(spark, lib):
    base = 0x25A5A5A5A5A5A5A5
    photos = rows(
        spark, "photos", photo(1, phash=base, file_size=5000), photo(2, phash=base ^ 3, file_size=9000), photo(3, phash=base ^ (0xFFFF << 40)),
        photo(4, phash=7), photo(5, phash=7), photo(6, phash=-1), photo(7, phash=-1),
    )
    lib = lib.with_tables(photos=photos)
    groups = duplicates.duplicate_groups(lib)
    assert [(r.group_key, r.size) for r in groups.orderBy("group_id").collect()] == [("1-2", 2), ("4-5", 2)]
    members = duplicates.group_members(lib, groups).filter("group_id = 1").orderBy("position").collect()
    assert [r.id for r in members] == [2, 1]
    kept = mutations.mark_duplicates(lib, 2, [1, 2])
    assert browse.photo_grid(kept).filter("id = 1").count() == 0 and kept.photos.count() == 7 and browse.hidden_duplicates(kept).first().id == 1
    assert browse.photo_grid(mutations.restore_duplicate(kept, 1)).filter("id = 1").count() == 1
    assert duplicates.duplicate_groups(mutations.dismiss_group(lib, [2, 1])).count() == 1
    with pytest.raises(ValueError):
        duplicates.hamming_pairs(photos, 8)


def test_members_of_all_groups(spark, monkeypatch):
    n = 10_050  # pairs of equal fingerprints
    photos = spark.range(2 * n).select(
        *[(F.col("id") if f.name == "id" else F.xxhash64(F.expr("id div 2")) if f.name == "phash" else F.lit(None)).cast(f.dataType).alias(f.name)
          for f in SCHEMAS["photos"].fields]
    )
    monkeypatch.setattr(registry, "load", lambda spark, sf_dir: Library.empty(spark).with_tables(photos=photos))
    members = registry.QUERIES["c12_group_members"](spark, "")
    assert members.count() == 2 * n


def test_bands_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**63), 2**63 - 1, 30)
    values = [int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 9), replace=False)) for b in base for _ in range(4)]
    got = {(r.a, r.b) for r in duplicates.hamming_pairs(spark.createDataFrame([(x,) for x in values], "phash long"), 7).collect()}
    mask = 2**64 - 1
    assert got == {(a, b) for a in set(values) for b in set(values) if a < b and ((a ^ b) & mask).bit_count() <= 7}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}


def test_search_boosts_and_person(spark):
    lib = load(spark, "/root/testdata/sf0.001")
    encode = lambda text: [float(x) for x in lib.clip_embeddings.filter("photo_id = 7").first().embedding]
    top = search.search(lib, "nothing", encode, limit=5).collect()
    assert top[0].photo_id == 7 and top[0].similarity > 0.99
    assert search.search(lib, "  ", encode).count() == 0
    boosted = search.search(lib, "nothing", encode, EngineConfig(search_favorite_boost=5.0), limit=5).collect()
    assert all(r.is_favorite for r in boosted)
    some = search.search(lib, "NATION_4 x", encode, limit=500)
    mine = {r.photo_id for r in lib.faces.filter("person_id = 4").collect()}
    assert {r.photo_id for r in some.collect()} <= mine
    cache = search.TextVectorCache(lambda t: [len(t)], "m", 1, capacity=2)
    assert cache(" Ab ") == cache("ab") and len(cache.entries) == 1
    cache("b"), cache("c")
    assert len(cache.entries) == 2


def test_albums_and_persons(spark, lib):
    lib, album = mutations.create_album(lib, "Trip", NOW)
    lib, added = mutations.add_to_album(lib, album, [3, 4, 5, 3], NOW)
    assert added == 3 and mutations.add_to_album(lib, album, [3, 4], NOW)[1] == 0
    assert lib.albums.first().cover_photo_id == 3 and stats.albums(lib).first().photos == 3
    lib = mutations.remove_from_album(mutations.rename_album(lib, album, "Tour", NOW), album, [3])
    assert lib.albums.first().name == "Tour" and lib.album_photos.count() == 2
    gone = mutations.delete_album(lib, album)
    assert gone.albums.count() == 0 and gone.album_photos.count() == 0 and gone.photos.count() == 30
    lib, person = mutations.create_person(lib, name="  ")
    assert lib.persons.first().display_name is None
    lib = mutations.rename_person(lib, person, " Ann ")
    assert browse.person_by_name(lib, "ann").first().id == person
    lib = lib.with_tables(faces=rows(spark, "faces", face(1, 1, unit(0)), face(2, 2, unit(0))))
    lib = mutations.confirm_face(lib, 1, person, C, NOW)
    assert lib.persons.first().face_count == 1 and lib.person_embeddings.first().is_representative
    lib = mutations.reject_representative(lib, person, 1, C, NOW)
    assert lib.persons.count() == 0 and lib.recognition_feedback.count() == 0  # the verdict goes with the person
    assert lib.faces.filter("person_id is not null").count() == 0


def test_backup_round_trip(spark, lib, tmp_path):
    photos = rows(spark, "photos", photo(1, is_favorite=True), photo(2))
    faces = rows(spark, "faces", face(1, 1, unit(0), 1), face(2, 2, unit(1)))
    persons = rows(spark, "persons", dict(id=1, display_name="Ann", face_count=1))
    verdict = rows(spark, "recognition_feedback", dict(face_id=2, person_id=1, verdict="reject", created_at=NOW))
    full = lib.with_tables(photos=photos, faces=faces, persons=persons, recognition_feedback=verdict)
    data = knowledge.backup(full, NOW)
    knowledge.save_backup(data, str(tmp_path / "b.json"))
    assert knowledge.load_backup(str(tmp_path / "b.json")) == data
    bare = lib.with_tables(photos=rows(spark, "photos", photo(1), photo(2)), faces=rows(spark, "faces", face(8, 1, unit(0)), face(9, 2, unit(1))))
    out, report = knowledge.restore(bare, data, NOW)
    assert report == dict(favorites=1, favorites_skipped=0, people=1, faces_assigned=1, faces_skipped=0, feedback=1, feedback_skipped=0)
    assert out.faces.filter("id = 8").first().person_id == out.persons.first().id and out.photos.filter("is_favorite").count() == 1
    again = knowledge.restore(out, data, NOW)[1]
    assert again["people"] == 0 and again["faces_assigned"] == 1
    empty = knowledge.restore(lib.with_tables(photos=lib.photos.limit(0)), data, NOW)[1]
    assert empty["favorites_skipped"] == 1 and empty["faces_skipped"] == 1 and empty["feedback_skipped"] == 1
    for bad in ({**data, "format": 2}, [], {**data, "people": [{"name": 1, "faces": []}]}):
        with pytest.raises(ValueError):
            knowledge.restore(bare, bad, NOW)


def png(width, height, rgb):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    line = b"\0" + bytes(rgb) * width
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(line * height)) + chunk(b"IEND", b"")


def jpeg_with_exif(width, height):
    make, taken = b"Acme\0", b"2021:07:04 12:34:56\0"
    gps = lambda *x: b"".join(struct.pack("<II", v, 1) for v in x)
    main_at = 8
    entries, extra_at = 4, 8 + 2 + 12 * 4 + 4
    exif_at = extra_at + len(make)
    gps_at = exif_at + 2 + 12 + 4 + len(taken)
    main = struct.pack("<H", entries) + struct.pack("<HHII", 0x010F, 2, len(make), extra_at) + struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0)
    main += struct.pack("<HHII", 0x8769, 4, 1, exif_at) + struct.pack("<HHII", 0x8825, 4, 1, gps_at) + struct.pack("<I", 0) + make
    exif = struct.pack("<H", 1) + struct.pack("<HHII", 0x9003, 2, len(taken), exif_at + 18) + struct.pack("<I", 0) + taken
    values = gps_at + 2 + 48 + 4
    gps_dir = struct.pack("<H", 4) + struct.pack("<HHI4s", 1, 2, 2, b"N\0\0\0") + struct.pack("<HHII", 2, 5, 3, values)
    gps_dir += struct.pack("<HHI4s", 3, 2, 2, b"W\0\0\0") + struct.pack("<HHII", 4, 5, 3, values + 24) + struct.pack("<I", 0)
    gps_dir += gps(37, 46, 30) + gps(122, 25, 10)
    tiff = b"II*\0" + struct.pack("<I", main_at) + main + exif + gps_dir
    app1 = b"Exif\0\0" + tiff
    frame = struct.pack(">BHHB", 8, height, width, 3) + b"\1\x11\0\2\x11\0\3\x11\0"
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xc0" + struct.pack(">H", len(frame) + 2) + frame + b"\xff\xd9"


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    (root / "sub").mkdir(parents=True)
    (root / "a.PNG").write_bytes(png(120, 80, (200, 0, 0)))
    (root / "sub/b.png").write_bytes(png(64, 64, (0, 0, 200)))
    (root / "sub/a_copy.png").write_bytes(png(120, 80, (200, 0, 0)))
    (root / "with_exif.jpg").write_bytes(jpeg_with_exif(200, 150))
    (root / "broken.jpg").write_bytes(b"not an image")
    (root / "notes.txt").write_text("no image")
    return str(root)


def test_scan_is_incremental(spark, tree, tmp_path):
    lib, first = scan_directory(Library.empty(spark), tree, NOW)
    assert first == dict(processed=5, skipped=0, duplicates=1, errors=0)
    got = {r.file_path.rsplit("/", 1)[1]: r for r in lib.photos.collect()}
    assert (got["a.PNG"].width, got["a.PNG"].height, got["broken.jpg"].width) == (120, 80, None)
    exif = got["with_exif.jpg"]
    assert (exif.width, exif.camera_make, exif.orientation, exif.taken_at) == (200, "Acme", 6, datetime(2021, 7, 4, 12, 34, 56))
    assert exif.gps_latitude == pytest.approx(37.775) and exif.gps_longitude == pytest.approx(-122.419444, abs=1e-5)
    assert [(r.year, r.month, r.photos) for r in stats.timeline_buckets(lib).collect()] == [(2021, 7, 1)]
    root = str(tmp_path / "state")
    write_snapshot(lib, root)
    lib = read_snapshot(spark, root)
    assert scan_directory(lib, tree, NOW)[1] == dict(processed=0, skipped=5, duplicates=0, errors=0)
    write_snapshot(mutations.reset_library(lib), root)
    assert Library.read(spark, root).photos.count() == 0


def test_stream_follows_a_folder(spark, tree, tmp_path):
    root = str(tmp_path / "state")
    write_snapshot(Library.empty(spark), root)
    for _ in range(2):
        watch(spark, tree, root, str(tmp_path / "stream"), lambda: NOW).awaitTermination()
    lib = Library.read(spark, root)
    assert lib.photos.count() == 5 and lib.scan_runs.filter("processed = 5").count() == 1


def test_import_run_with_stub_models(spark, tree):
    lib, _ = scan_directory(Library.empty(spark), tree, NOW)

    def clip():
        return lambda content: [1.0, 2.0, 2.0] if content[:4] == b"\x89PNG" else (_ for _ in ()).throw(ValueError("no"))

    def ocr():
        return lambda content: ["INVOICE", "total "] if content[:4] == b"\x89PNG" else None

    def faces():
        return lambda content: [(1.0, 1.0, 60.0, 60.0, 0.9, [1.0, 0.0, 0.0]), (1.0, 1.0, 9.0, 9.0, 0.1, [1.0, 0.0, 0.0]), (float("nan"), 1.0, 9.0, 9.0, 0.9, [1.0, 0.0, 0.0])]

    run = ImportRun(default_steps(C, faces=faces, clip=clip, ocr=ocr, dim=3))
    files = images.image_files(spark, tree).select(F.col("path").alias("file_path"), "content")
    seen = []
    out = run.run(lib, lambda photos: photos.join(files, "file_path"), seen.append)
    assert seen == ["faces", "people", "clip", "ocr"]
    assert run.reports["clip"] == {"processed": 3, "errors": 2} and run.reports["ocr"] == {"processed": 5, "with_text": 3}
    assert out.faces.count() == 4 and out.persons.count() == 1  # the broken file has no size to clamp a box to
    assert out.clip_embeddings.first().embedding == pytest.approx([1 / 3, 2 / 3, 2 / 3])
    assert browse.pending_ocr(out).count() == 0 and out.photos.filter("ocr_text = 'INVOICE\ntotal'").count() == 3


def test_phash_of_files(spark, tree):
    got = {r.file_path.rsplit("/", 1)[1]: r.phash for r in images.photo_hashes(spark, tree).collect()}
    assert got["a.PNG"] == got["a_copy.png"] == 0 and got["broken.jpg"] == images.UNHASHABLE
    slope = np.tile(np.linspace(255, 0, 90), (40, 1))
    assert images.dhash(slope) == -1 and images.dhash(slope[:, ::-1]) == 0
    noise = np.random.default_rng(0).integers(0, 255, (80, 90))
    big = np.kron(noise, np.ones((3, 3)))
    assert ((images.dhash(noise) ^ images.dhash(big)) & (2**64 - 1)).bit_count() <= 5


def test_thumbnails_and_crops(spark, tree, tmp_path):
    lib, _ = scan_directory(Library.empty(spark), tree, NOW)
    out, report = make_thumbnails(lib, tree, str(tmp_path / "thumbs"), size=50)
    assert report == {"generated": 3, "errors": 2}  # one JPEG is broken, one is headers alone
    paths = {r.file_path.rsplit("/", 1)[1]: r.thumbnail_path for r in out.photos.collect()}
    assert paths["broken.jpg"] is None
    sizes = {n: (f["width"], f["height"]) for n, p in paths.items() if p for f in [images.read_facts(open(p, "rb").read())]}
    assert sizes["a.PNG"] == (50, 33)
    assert all(p.endswith(".jpg") and open(p, "rb").read(2) == b"\xff\xd8" for p in paths.values() if p)
    turned = images.thumbnails(lib.photos.filter("file_path like '%a.PNG'").select("id", "file_path", F.lit(6).alias("orientation")), tree, 60).first()
    assert [images.read_facts(bytes(turned.image))[x] for x in ("width", "height")] == [40, 60]
    faces = out.photos.filter("file_path like '%a.PNG'").select(
        F.lit("7_0.jpg").alias("crop_path"), "file_path", F.lit(10).alias("bbox_x"), F.lit(5).alias("bbox_y"), F.lit(30).alias("bbox_w"), F.lit(20).alias("bbox_h")
    )
    crop = images.face_crops(faces, tree).first()
    assert images.read_facts(bytes(crop.image))["width"] == 30 and images.read_facts(bytes(crop.image))["height"] == 20


def test_orientations():
    px = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    turned = {6: np.rot90(px, -1), 8: np.rot90(px), 3: px[::-1, ::-1], 2: px[:, ::-1], 4: px[::-1], 5: px.swapaxes(0, 1), 1: px, None: px}
    for o, want in turned.items():
        assert (images.oriented(px, o) == want).all()
    assert (images.oriented(px, 7) == np.rot90(px, 2).swapaxes(0, 1)).all()


def test_files_that_cannot_be_read_are_counted(spark, tree):
    files = images.image_files(spark, tree)
    listed = files.select("path").unionByName(spark.createDataFrame([("file:/gone.jpg",)], "path string"))
    lib, report = scan(Library.empty(spark), files, tree, NOW, listed)
    assert report == dict(processed=5, skipped=0, duplicates=1, errors=1)
    assert scan(lib, files, tree, NOW, listed)[1] == dict(processed=0, skipped=5, duplicates=0, errors=1)


def test_of_two_writers_one_succeeds(spark, tmp_path):
    root = str(tmp_path / "state")
    lib = Library.empty(spark)
    first = write_snapshot(lib, root)
    assert snapshots.version(spark, root) == 1
    with pytest.raises(snapshots.Conflict):
        snapshots._publish(spark, root, 1, "other")
    with pytest.raises(snapshots.Conflict):
        write_snapshot(lib, root, expected=0)
    assert snapshots.current_snapshot(spark, root) == first
    lib = lib.with_tables(albums=spark.createDataFrame([(1, "a", None, NOW, NOW)], SCHEMAS["albums"]))
    write_snapshot(lib, root, expected=1)
    compact = snapshots.optimize_after_import(spark, root)
    assert snapshots.current_snapshot(spark, root) == compact and read_snapshot(spark, root).albums.count() == 1


def test_vectors_are_kept_in_files(tmp_path):
    asked = []
    encode = lambda text: asked.append(text) or [1.0, 0.5]
    for _ in range(2):
        cache = search.TextVectorCache(encode, "m", 1, folder=str(tmp_path))
        assert cache(" Red car") == (1.0, 0.5) == cache("red CAR ")
    assert len(asked) == 1
    next(tmp_path.iterdir()).write_text("broken")
    assert search.TextVectorCache(encode, "m", 1, folder=str(tmp_path))("red car") == (1.0, 0.5) and len(asked) == 2


def clustered_vectors(n, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    v = centres[rng.integers(0, 12, n)] + rng.normal(scale=0.25, size=(n, dim))
    v[:5] = 0
    v[5:60] = rng.normal(size=(55, dim))
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


@pytest.mark.parametrize("block", [64, 5_000])
def test_products_around_pivots_lose_no_hit(spark, monkeypatch, block):
    """Blocks so small that there are many pivots, or one block, give what one product of all vectors gives."""
    monkeypatch.setattr(products, "BLOCK", block)
    v = clustered_vectors(900)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>").repartition(4).cache()
    got = recognition.best_scores(
        rows.filter("id < 400").select(F.col("id").alias("face_id"), F.col("embedding").alias("vector")),
        rows.filter("id >= 300").select((F.col("id") % 50).alias("person_id"), F.col("embedding").alias("vector")), 0.6,
    )
    sims = v[:400] @ v[300:].T
    want = {}
    for i, j in zip(*np.nonzero(sims >= 0.6)):
        key = (int(i), int(j + 300) % 50)
        want[key] = max(want.get(key, -1), sims[i, j])
    assert {(r.face_id, r.person_id): pytest.approx(r.score, abs=1e-9) for r in got.collect()} == want
    eps, least = 0.12, 6
    near = v @ v.T >= 1 - eps
    np.fill_diagonal(near, True)
    core = near.sum(1) >= least
    label = np.where(core, np.arange(900), 10**6)
    while True:
        new = np.where(core, np.where(near & core[None, :], label[None, :], 10**6).min(1), label)
        if (new == label).all():
            break
        label = new
    reach = np.where(near & core[None, :], label[None, :], 10**6).min(1)
    cluster = np.where(core, label, np.where(reach < 10**6, reach, -1))
    found = {r.id: r.cluster for r in clustering.dbscan(rows, eps, least).collect()}
    assert found == dict(enumerate(cluster.tolist())) and len(set(cluster.tolist())) > 5


def chained_vectors(n, seed):
    """Tight clusters, an arc of neighbours that runs through many blocks, scattered vectors and two without length."""
    rng = np.random.default_rng(seed)
    turn = np.linspace(0, 2.5, n // 3)
    arc = np.zeros((n // 3, 6))
    arc[:, 0], arc[:, 1] = np.cos(turn), np.sin(turn)
    tight = np.repeat(rng.normal(size=(9, 6)), n // 27, axis=0) + rng.normal(scale=0.05, size=(n // 27 * 9, 6))
    v = np.concatenate([arc, tight, rng.normal(size=(n - len(arc) - len(tight) - 2, 6)), np.zeros((2, 6))])
    v = rng.permutation(v)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


@pytest.mark.parametrize("draw, eps, least", [(1, 0.002, 3), (40, 0.02, 12)])
def test_dbscan_is_exact_whatever_the_first_look_finds(spark, monkeypatch, draw, eps, least):
    monkeypatch.setattr(products, "BLOCK", 50)
    monkeypatch.setattr(products, "DRAWN", draw)
    v = chained_vectors(700, draw)
    df = spark.createDataFrame([(3 * i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>").repartition(3)
    near = v @ v.T >= 1 - eps - 1e-12
    np.fill_diagonal(near, True)
    core = near.sum(1) >= least
    label = np.where(core, 3 * np.arange(len(v)), 10**6)
    while True:
        new = np.where(core, np.where(near & core[None, :], label[None, :], 10**6).min(1), label)
        if (new == label).all():
            break
        label = new
    reach = np.where(near & core[None, :], label[None, :], 10**6).min(1)
    want = np.where(core, label, np.where(reach < 10**6, reach, -1)).tolist()
    got = {r.id: r.cluster for r in clustering.dbscan(df, eps, least).collect()}
    assert got == {3 * i: c for i, c in enumerate(want)}


def test_dbscan_of_dense_vectors_multiplies_few_pairs(spark, monkeypatch):
    """What the first look has settled is not multiplied again, so the work is not the square of the vectors."""
    monkeypatch.setattr(products, "BLOCK", 50)
    monkeypatch.setattr(products, "DRAWN", 100, raising=False)
    pairs = []

    def counted(left, right, *more):
        pairs.append(left.count() * (left if right is None else right).count())
        return products.near_products(left, right, *more)

    monkeypatch.setattr(clustering, "near_products", counted)
    v = np.random.default_rng(4).normal(size=(1500, 5))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    assert {r.cluster for r in clustering.dbscan(df, 0.3, 3).collect()} == {0}
    assert sum(pairs) < 0.02 * len(v) ** 2


def test_blocks_out_of_reach_do_not_meet(spark, monkeypatch):
    """Twelve tight clusters: far fewer rows of block pairs than all."""
    monkeypatch.setattr(products, "BLOCK", 50)
    rng = np.random.default_rng(3)
    v = np.repeat(np.eye(12, 16), 100, axis=0) + rng.normal(scale=0.01, size=(1200, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, 0, x.tolist()) for i, x in enumerate(v)], "id long, label long, vector array<double>")
    one = lambda *a: pd.DataFrame({"n": [1]})
    met = products.near_products(rows, None, 0.8, one, "n long").count()
    assert met < 150


@pytest.mark.parametrize("distance", [0, 3, 5, 7])
def test_hamming_pairs_miss_none(spark, distance):
    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = {scalars.to_signed(b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 7)))) for b in base for _ in range(6)} | {0, -1, 1, 2**62}
    rows = spark.createDataFrame([(x,) for x in values], "phash long")
    want = {(a, b) for a in values for b in values if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= distance}
    got = [(r.a, r.b) for r in duplicates.hamming_pairs(rows, distance).collect()]
    assert len(got) == len(set(got)) and set(got) == want
