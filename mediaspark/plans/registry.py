"""Queries over the driver's tables and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import scalars, vectors
from ..operators import browse, clustering, duplicates, knowledge, merging, mutations, recognition, search, stats
from ..schemas import SCHEMAS, Library
from .library import QUALITY, load, with_views

CONFIG = EngineConfig()
#: The tables' vectors lie far apart, so queries that need near ones use wider limits.
LOOSE = EngineConfig(face_match_threshold=0.42, merge_suggest_threshold=0.30, merge_auto_threshold=0.45)
NOW = datetime(2024, 6, 1)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, run: Callable[[Library], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(load(spark, sf_dir))
    if sql:
        ORACLE_SQL[name] = with_views(sql)


def _vector_of(lib: Library, vec_id: int):
    row = lib.clip_embeddings.filter(F.col("photo_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]]


BRIEF = "id, file_path, thumbnail_path"
NEWEST = "ORDER BY taken_at DESC NULLS LAST, id DESC"

# Pages, details and filters
query("f1_photo_grid", lambda lib: browse.photo_grid(lib),
      f"SELECT {BRIEF}, taken_at FROM photos WHERE duplicate_of IS NULL {NEWEST} LIMIT 300")
query("f1_photo_grid_person_text", lambda lib: browse.photo_grid(lib, 100, 5, person_id=3, search="src1"),
      f"SELECT {BRIEF}, taken_at FROM photos WHERE duplicate_of IS NULL AND id IN (SELECT photo_id FROM faces WHERE person_id = 3) "
      f"AND (file_path ILIKE '%src1%' OR camera_model ILIKE '%src1%') {NEWEST} LIMIT 100 OFFSET 5")
query("t1_keyset_page", lambda lib: browse.photo_grid_after(lib, datetime(1998, 5, 1), 500, 60),
      f"SELECT {BRIEF}, taken_at FROM photos WHERE duplicate_of IS NULL AND (taken_at IS NULL OR taken_at < TIMESTAMP '1998-05-01' "
      f"OR (taken_at = TIMESTAMP '1998-05-01' AND id < 500)) {NEWEST} LIMIT 60")
query("f2_photo_detail", lambda lib: browse.photo_detail(lib, 42), f"SELECT {', '.join(browse.DETAIL)} FROM photos WHERE id = 42")
query("f3_photos_by_ids", lambda lib: browse.photos_by_ids(lib, [5, 3, 150, 10**9]),
      "SELECT id, file_path FROM photos WHERE id IN (5, 3, 150, 1000000000)")
query("f4_photos_brief", lambda lib: browse.photos_brief(lib, [9, 2, 10**9, 2, 77]),
      f"SELECT w.position, p.id, p.file_path, p.thumbnail_path, p.taken_at FROM (VALUES (0, 9), (1, 2), (3, 2), (4, 77)) w(position, id) "
      "JOIN photos p ON p.id = w.id")
query("f5_largest_first", lambda lib: browse.photos_largest_first(lib, [9, 2, 77]),
      "SELECT id, file_path, thumbnail_path, file_size FROM photos WHERE id IN (9, 2, 77)")
query("f6_photos_by_month", lambda lib: browse.photos_by_month(lib, 1997, 12),
      f"SELECT {BRIEF}, taken_at FROM photos WHERE taken_at >= TIMESTAMP '1997-12-01' AND taken_at < TIMESTAMP '1998-01-01' {NEWEST} LIMIT 300")
query("f7_on_this_day", lambda lib: browse.on_this_day(lib, 3, 14),
      f"SELECT {BRIEF}, taken_at FROM photos WHERE month(taken_at) = 3 AND day(taken_at) = 14 {NEWEST} LIMIT 50")
query("f8_recent_photos", lambda lib: browse.recent_photos(lib), f"SELECT {BRIEF} FROM photos ORDER BY id DESC LIMIT 20")
query("f9_hashed_photos", lambda lib: browse.hashed_photos(lib),
      "SELECT id, phash FROM photos WHERE phash IS NOT NULL AND phash <> -1 AND duplicate_of IS NULL")
query("f10_hidden_duplicates", lambda lib: browse.hidden_duplicates(lib, 40),
      "SELECT id, file_path, duplicate_of, updated_at FROM photos WHERE duplicate_of IS NOT NULL ORDER BY updated_at DESC, id DESC LIMIT 40")
query("f11_person_by_name", lambda lib: browse.person_by_name(lib, " " + "NATION_4 ".lower()),
      "SELECT min(id) AS id FROM persons WHERE lower(trim(display_name)) = 'nation_4' HAVING count(*) = 1")
query("f12_photos_by_ocr",
      lambda lib: browse.photos_by_ocr(lib, ["license", "ou", "inonst"], 50, True, datetime(1996, 1, 1), datetime(2000, 1, 1)),
      f"SELECT {BRIEF}, taken_at FROM photos WHERE (ocr_text ILIKE '%license%' OR ocr_text ILIKE '%inonst%') AND is_favorite "
      f"AND taken_at >= TIMESTAMP '1996-01-01' AND taken_at <= TIMESTAMP '2000-01-01' {NEWEST} LIMIT 50")
query("f13_ungrouped_faces", lambda lib: lib.faces.filter("person_id is null").select(
          "id", F.coalesce("det_score", F.lit(0.0)).alias("det_score"), "bbox_w", "bbox_h", F.size("embedding").alias("dim")),
      "SELECT id, coalesce(det_score, 0) AS det_score, bbox_w, bbox_h, cast(len(embedding) as int) AS dim FROM faces WHERE person_id IS NULL")
query("f13_gallery", lambda lib: lib.person_embeddings.filter("person_id = 3").select(
          "face_id", F.round("quality", 6).alias("quality"), "is_representative"),
      "SELECT face_id, round(quality, 6) AS quality, is_representative FROM person_embeddings WHERE person_id = 3")
query("f14_rejections", lambda lib: lib.recognition_feedback.filter("verdict = 'reject'").select("face_id", "person_id"),
      "SELECT face_id, person_id FROM recognition_feedback WHERE verdict = 'reject'")
query("f15_command_match", lambda lib: lib.photos.filter(scalars.subsequence_match("l s1 pg", F.col("file_path"))).select("id"),
      "SELECT id FROM photos WHERE regexp_matches(lower(file_path), 'l.*s.*1.*p.*g')")

# Pending work
query("s9_pending_faces", lambda lib: browse.pending_faces(lib), "SELECT id, file_path FROM photos WHERE NOT faces_processed")
query("s10_pending_thumbnails", lambda lib: browse.pending_thumbnails(lib), "SELECT id, file_path FROM photos WHERE thumbnail_path IS NULL")
query("s11_pending_clip", lambda lib: browse.pending_clip(lib, "m1", 1),
      "SELECT id, file_path FROM photos WHERE NOT EXISTS (SELECT 1 FROM clip_embeddings c WHERE c.photo_id = photos.id AND c.model = 'm1' AND c.version = 1)")
query("s12_pending_ocr", lambda lib: browse.pending_ocr(lib), "SELECT id, file_path FROM photos WHERE ocr_text IS NULL")
query("s13_pending_phash", lambda lib: browse.pending_phash(lib), "SELECT id, file_path FROM photos WHERE phash IS NULL")
query("s14_pending_counts", lambda lib: browse.pending_counts(lib, "m1", 1),
      "SELECT count(*) FILTER (WHERE NOT faces_processed) AS faces, count(*) FILTER (WHERE thumbnail_path IS NULL) AS thumbnails, "
      "count(*) FILTER (WHERE ocr_text IS NULL) AS ocr, count(*) FILTER (WHERE phash IS NULL) AS phash, count(*) FILTER (WHERE id NOT IN "
      "(SELECT photo_id FROM clip_embeddings WHERE model = 'm1' AND version = 1)) AS clip FROM photos")
query("s15_recent_scan_runs", lambda lib: browse.recent_scan_runs(lib, 3), "SELECT * FROM scan_runs ORDER BY id DESC LIMIT 3")

# Counts and profiles
query("a1_counts", lambda lib: stats.counts(lib), """
    SELECT (SELECT count(*) FROM photos) AS photos, (SELECT count(*) FROM photos WHERE duplicate_of IS NOT NULL) AS hidden,
      (SELECT count(*) FROM photos WHERE ocr_text <> '') AS ocr_texts, (SELECT count(*) FROM faces) AS faces,
      (SELECT count(*) FROM faces WHERE person_id IS NULL) AS ungrouped, (SELECT count(*) FROM persons) AS persons,
      (SELECT count(*) FROM albums) AS albums, (SELECT count(*) FROM clip_embeddings) AS clip,
      (SELECT count(*) FROM recognition_suggestions s JOIN faces f ON f.id = s.face_id WHERE f.person_id IS NULL) AS suggestions,
      (SELECT count(*) FROM person_merge_suggestions) AS merge_suggestions""")
query("a2_library_stats", lambda lib: stats.library_stats(lib), """
    SELECT (SELECT count(*) FROM photos) AS photos, (SELECT coalesce(sum(file_size), 0)::BIGINT FROM photos) AS bytes,
      (SELECT count(*) FROM faces) AS faces, (SELECT count(*) FROM persons) AS persons""")
query("a3_knowledge_stats", lambda lib: stats.knowledge_stats(lib), """
    SELECT (SELECT count(*) FROM photos) AS photos, (SELECT count(taken_at) FROM photos) AS dated, (SELECT count(gps_latitude) FROM photos) AS located,
      (SELECT count(*) FROM photos WHERE ocr_text <> '') AS with_text, (SELECT min(taken_at) FROM photos) AS first_date,
      (SELECT max(taken_at) FROM photos) AS last_date, (SELECT coalesce(sum(file_size), 0)::BIGINT FROM photos) AS storage_bytes,
      (SELECT count(*) FROM faces) AS faces, (SELECT count(*) FROM faces WHERE person_id IS NULL) AS faces_ungrouped,
      (SELECT count(*) FROM persons) AS persons, (SELECT count(display_name) FROM persons) AS named_persons,
      (SELECT count(*) FROM clip_embeddings) AS searchable""")
query("a4_timeline", lambda lib: stats.timeline_buckets(lib),
      "SELECT year(taken_at)::INT AS year, month(taken_at)::INT AS month, count(*) AS photos FROM photos WHERE taken_at IS NOT NULL GROUP BY 1, 2")
query("a5_person_profile", lambda lib: stats.person_profile(lib, 3), """
    SELECT count(DISTINCT p.id) AS photo_count, min(p.taken_at) AS first_seen, max(p.taken_at) AS last_seen,
      (SELECT c.crop_path FROM persons r JOIN faces c ON c.id = r.cover_face_id WHERE r.id = 3) AS cover_path
    FROM faces f JOIN photos p ON p.id = f.photo_id WHERE f.person_id = 3""")
query("a6_appears_with", lambda lib: stats.appears_with(lib, 3), """
    SELECT r.id, r.display_name, count(DISTINCT f.photo_id) AS shared, c.crop_path FROM faces f
      JOIN faces g ON g.photo_id = f.photo_id AND g.person_id <> f.person_id JOIN persons r ON r.id = g.person_id
      LEFT JOIN faces c ON c.id = r.cover_face_id WHERE f.person_id = 3 GROUP BY r.id, r.display_name, c.crop_path
    ORDER BY shared DESC, r.id LIMIT 8""")
query("a7_albums", lambda lib: stats.albums(lib), """
    SELECT a.id, a.name, count(x.photo_id) AS photos, p.thumbnail_path AS cover_path, a.updated_at FROM albums a
      LEFT JOIN album_photos x ON x.album_id = a.id LEFT JOIN photos p ON p.id = a.cover_photo_id GROUP BY ALL""")
query("j15_album_photos", lambda lib: stats.album_photos(lib, 2, 100, 3),
      f"SELECT {BRIEF}, is_favorite, taken_at FROM photos WHERE id IN (SELECT photo_id FROM album_photos WHERE album_id = 2) {NEWEST} LIMIT 100 OFFSET 3")
query("j3_persons_with_cover", lambda lib: stats.persons_with_cover(lib),
      "SELECT p.id, p.display_name, p.face_count, f.crop_path AS cover_path FROM persons p LEFT JOIN faces f ON f.id = p.cover_face_id")
query("j7_photo_people", lambda lib: stats.photo_people(lib, 5),
      "SELECT DISTINCT p.id, p.display_name, f.crop_path FROM faces f JOIN persons p ON p.id = f.person_id WHERE f.photo_id = 5")
query("c17_review_count", lambda lib: stats.review_count(lib), """
    SELECT (SELECT count(*) FROM recognition_suggestions s JOIN faces f ON f.id = s.face_id WHERE f.person_id IS NULL)
      + (SELECT count(*) FROM person_merge_suggestions) AS review_count""")

# Review lists
_SUGGEST = """
    SELECT s.face_id, s.person_id, s.score, p.display_name, f.photo_id, f.crop_path, c.crop_path AS cover_path FROM recognition_suggestions s
      JOIN faces f ON f.id = s.face_id AND f.person_id IS NULL JOIN persons p ON p.id = s.person_id LEFT JOIN faces c ON c.id = p.cover_face_id"""
query("j4_suggestions", lambda lib: merging.suggestions_detail(lib, 30), _SUGGEST + " ORDER BY s.score DESC, s.face_id LIMIT 30")
query("j4_person_suggestions", lambda lib: merging.suggestions_detail(lib, person_id=4), _SUGGEST + " WHERE s.person_id = 4")
query("j5_merge_suggestions", lambda lib: merging.merge_suggestions_detail(lib), """
    SELECT s.person_a, s.person_b, s.score, a.display_name AS name_a, b.display_name AS name_b, a.face_count AS size_a, b.face_count AS size_b,
      x.crop_path AS crop_a, y.crop_path AS crop_b, CASE WHEN a.display_name IS NOT NULL AND b.display_name IS NULL THEN 'a'
        WHEN a.display_name IS NULL AND b.display_name IS NOT NULL THEN 'b' WHEN a.face_count >= b.face_count THEN 'a' ELSE 'b' END AS keep
    FROM person_merge_suggestions s JOIN persons a ON a.id = s.person_a JOIN persons b ON b.id = s.person_b
      LEFT JOIN faces x ON x.id = a.cover_face_id LEFT JOIN faces y ON y.id = b.cover_face_id""")
query("j8_representatives", lambda lib: merging.representatives_detail(lib, 3).withColumn("quality", F.round("quality", 6)), """
    SELECT e.face_id, f.photo_id, f.crop_path, p.file_path, p.taken_at, round(e.quality, 6) AS quality FROM person_embeddings e
      JOIN faces f ON f.id = e.face_id JOIN photos p ON p.id = f.photo_id WHERE e.person_id = 3 AND e.is_representative""")
query("j10_missing_gallery", lambda lib: recognition.persons_missing_gallery(lib),
      "SELECT DISTINCT person_id AS id FROM faces WHERE person_id IS NOT NULL AND person_id NOT IN (SELECT person_id FROM person_embeddings)")

# Vectors
_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
query("t3_nearest", lambda lib: search.nearest(lib, _vector_of(lib, 7), "m1", 50).withColumn("similarity", F.round("similarity", 6)), f"""
    SELECT e.photo_id, round({_COS}, 6) AS similarity FROM clip_embeddings e, (SELECT embedding FROM clip_embeddings WHERE photo_id = 7) q
    WHERE e.model = 'm1' ORDER BY {_COS} DESC, e.photo_id LIMIT 50""")
query("t3_nearest_filtered",
      lambda lib: search.nearest(lib, _vector_of(lib, 7), "m1", 20, favorite=True, since=datetime(1996, 1, 1), person_id=2).withColumn(
          "similarity", F.round("similarity", 6)), f"""
    SELECT e.photo_id, round({_COS}, 6) AS similarity FROM clip_embeddings e, (SELECT embedding FROM clip_embeddings WHERE photo_id = 7) q
    WHERE e.model = 'm1' AND e.photo_id IN (SELECT id FROM photos WHERE is_favorite AND taken_at >= TIMESTAMP '1996-01-01'
      AND id IN (SELECT photo_id FROM faces WHERE person_id = 2)) ORDER BY {_COS} DESC, e.photo_id LIMIT 20""")
query("t4_similar_photos", lambda lib: search.similar_photos(lib, 12, 15).withColumn("similarity", F.round("similarity", 6)), f"""
    SELECT e.photo_id, p.file_path, p.thumbnail_path, round({_COS}, 6) AS similarity FROM clip_embeddings e
      JOIN (SELECT * FROM clip_embeddings WHERE photo_id = 12) q ON q.model = e.model AND e.photo_id <> 12 JOIN photos p ON p.id = e.photo_id
    ORDER BY {_COS} DESC, e.photo_id LIMIT 15""")


def _elements(df: DataFrame) -> DataFrame:
    return df.select("person_id", F.posexplode("centroid").alias("pos", "x")).select("person_id", "pos", F.round("x", 6).alias("x"))


_UNIT = """
    u AS (SELECT person_id, i - 1 AS pos, avg(embedding[i]::DOUBLE {div}) AS x FROM
        (SELECT person_id, embedding, sqrt(list_sum([v::DOUBLE * v::DOUBLE FOR v IN embedding])) AS n, unnest(range(1, len(embedding) + 1)) AS i
         FROM faces WHERE person_id IS NOT NULL) GROUP BY 1, 2),
    n AS (SELECT person_id, sqrt(sum(x * x)) AS n FROM u GROUP BY 1)
    SELECT u.person_id, u.pos::INT AS pos, round(u.x / n.n, 6) AS x FROM u JOIN n USING (person_id)"""
query("a8_person_centroids", lambda lib: _elements(recognition.person_centroids(lib.faces)), "WITH " + _UNIT.format(div="/ n").strip())
query("a9_raw_centroids", lambda lib: _elements(recognition.person_centroids(lib.faces, normalize_rows=False)),
      "WITH " + _UNIT.format(div="").strip())
query("a11_consistency", lambda lib: vectors.consistency(lib.person_embeddings.filter("is_representative"), ["person_id"]).withColumn(
          "consistency", F.round("consistency", 6)), """
    SELECT a.person_id, count(DISTINCT a.face_id) AS n,
      round(greatest(0, least(1, avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) FILTER (WHERE a.face_id <> b.face_id))), 6) AS consistency
    FROM person_embeddings a JOIN person_embeddings b ON a.person_id = b.person_id AND b.is_representative WHERE a.is_representative GROUP BY 1""")
query("a13_cover_faces", lambda lib: recognition.cover_faces(lib.faces), "SELECT id AS person_id, cover_face_id FROM persons")
query("x1_normalized", lambda lib: lib.faces.select(
          "id", F.round(vectors.norm(F.col("embedding")), 6).alias("length"),
          F.round(vectors.l2_normalize(F.col("embedding"))[0], 6).alias("first")), """
    SELECT id, round(sqrt(list_sum([v::DOUBLE * v::DOUBLE FOR v IN embedding])), 6) AS length,
      round(embedding[1]::DOUBLE / sqrt(list_sum([v::DOUBLE * v::DOUBLE FOR v IN embedding])), 6) AS first FROM faces""")

# Search
query("c13_search", lambda lib: search.search(lib, "licensed under", lambda text: _vector_of(lib, 7), CONFIG, 40).select(
          "photo_id", "file_path", "is_favorite", "ocr_hit", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score")), f"""
    WITH c AS (SELECT e.photo_id, {_COS} AS similarity FROM clip_embeddings e, (SELECT embedding FROM clip_embeddings WHERE photo_id = 7) q
        WHERE e.model = 'm1' ORDER BY similarity DESC, e.photo_id LIMIT 200),
    o AS (SELECT id AS photo_id FROM photos WHERE ocr_text ILIKE '%licensed%' OR ocr_text ILIKE '%under%' {NEWEST} LIMIT 200),
    a AS (SELECT p.id AS photo_id, p.file_path, p.is_favorite, p.taken_at, coalesce(c.similarity, 0) AS similarity, o.photo_id IS NOT NULL AS ocr_hit,
        c.photo_id IS NOT NULL AS in_clip FROM c FULL JOIN o ON o.photo_id = c.photo_id JOIN photos p ON p.id = coalesce(c.photo_id, o.photo_id)),
    r AS (SELECT *, coalesce((epoch_us(taken_at) - min(epoch_us(taken_at)) OVER ()) / (max(epoch_us(taken_at)) OVER () - min(epoch_us(taken_at)) OVER ()), 0) AS rec FROM a),
    s AS (SELECT *, similarity + CASE WHEN ocr_hit THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN is_favorite THEN 0.15::DOUBLE ELSE 0 END + 0.05::DOUBLE * rec AS score FROM r)
    SELECT photo_id, file_path, is_favorite, ocr_hit, round(similarity, 6) AS similarity, round(score, 6) AS score FROM s
    ORDER BY s.score DESC, in_clip DESC, s.similarity DESC, taken_at DESC NULLS LAST, photo_id DESC LIMIT 40""")

# Near duplicates
_VISIBLE = "(SELECT id, phash FROM photos WHERE phash IS NOT NULL AND phash <> -1 AND duplicate_of IS NULL)"
query("j19_hamming_pairs", lambda lib: duplicates.hamming_pairs(browse.hashed_photos(lib)).withColumn("distance", F.col("distance").cast("int")), f"""
    WITH h AS (SELECT DISTINCT phash FROM {_VISIBLE})
    SELECT x.phash AS a, y.phash AS b, bit_count(xor(x.phash, y.phash))::INT AS distance FROM h x JOIN h y ON x.phash < y.phash
      AND bit_count(xor(x.phash, y.phash)) <= 5""")
_GROUPS = f"""
    WITH RECURSIVE h AS (SELECT DISTINCT phash FROM {_VISIBLE}),
    e AS (SELECT x.phash AS a, y.phash AS b FROM h x JOIN h y ON bit_count(xor(x.phash, y.phash)) <= 5),
    t AS (SELECT phash AS v, phash AS x FROM h UNION SELECT t.v, e.b FROM t JOIN e ON e.a = t.x),
    c AS (SELECT v, min(x) AS g FROM t GROUP BY v),
    m AS (SELECT c.g, p.id FROM {_VISIBLE} p JOIN c ON c.v = p.phash),
    z AS (SELECT g, count(*) AS n, min(id) AS group_id FROM m GROUP BY g HAVING count(*) > 1)"""
query("c11_photo_groups", lambda lib: duplicates.photo_groups(browse.hashed_photos(lib)),
      _GROUPS + " SELECT z.group_id, m.id, z.n FROM m JOIN z USING (g)")
query("c12_duplicate_groups", lambda lib: duplicates.duplicate_groups(lib).select("group_id", "group_key", "size"), _GROUPS + """
    SELECT group_id, string_agg(id::VARCHAR, '-' ORDER BY id) AS group_key, count(*)::INT AS size FROM m JOIN z USING (g)
    GROUP BY group_id ORDER BY size DESC, group_id LIMIT 50""")
query("c12_group_members", lambda lib: duplicates.group_members(lib, duplicates.duplicate_groups(lib, limit=None)), _GROUPS + """
    SELECT z.group_id, (row_number() OVER (PARTITION BY z.group_id ORDER BY p.file_size DESC, p.id))::INT AS position, p.id, p.file_path, p.file_size
    FROM m JOIN z USING (g) JOIN photos p ON p.id = m.id""")
query("s6_exact_duplicates", lambda lib: duplicates.exact_duplicates(lib), """
    SELECT id, original FROM (SELECT id, min(id) OVER (PARTITION BY file_hash) AS original FROM photos) WHERE id <> original""")

# Quality, thresholds, context
query("x5_face_quality", lambda lib: recognition.with_quality(lib.faces).select(
          "id", F.round("quality", 6).alias("quality"), scalars.quality_band(F.col("quality")).alias("band")), f"""
    WITH q AS (SELECT id, {QUALITY} AS q FROM faces)
    SELECT id, round(q, 6) AS quality, CASE WHEN q >= 0.8::DOUBLE THEN 'excellent' WHEN q >= 0.6::DOUBLE THEN 'good'
      WHEN q >= 0.35::DOUBLE THEN 'store' ELSE 'ignore' END AS band FROM q""")
query("x7_adaptive_thresholds", lambda lib: recognition.gallery_thresholds(lib.person_embeddings, CONFIG).select(
          "person_id", "n", F.round("threshold", 6).alias("threshold")), """
    WITH c AS (SELECT a.person_id, count(DISTINCT a.face_id) AS n, greatest(0, least(1, avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))
        FILTER (WHERE a.face_id <> b.face_id))) AS k FROM person_embeddings a JOIN person_embeddings b
        ON a.person_id = b.person_id AND b.is_representative WHERE a.is_representative GROUP BY 1)
    SELECT person_id, n, CASE WHEN n < 3 THEN NULL ELSE round(least(CASE WHEN n < 6 THEN 0.55::DOUBLE ELSE 1 END,
      greatest(0.45::DOUBLE, least(0.62::DOUBLE, 0.55::DOUBLE + (k - 0.5::DOUBLE) * (0.62::DOUBLE - 0.45::DOUBLE)))), 6) END AS threshold FROM c""")
query("x8_gps_cells", lambda lib: lib.photos.select("id", scalars.gps_cell(F.col("gps_latitude"), F.col("gps_longitude")).alias("c")).filter(
          "c is not null").select("id", "c.y", "c.x"), """
    SELECT id, round_even(gps_latitude / 0.001::DOUBLE, 0)::BIGINT AS y, round_even(gps_longitude / 0.001::DOUBLE, 0)::BIGINT AS x
    FROM photos WHERE gps_latitude IS NOT NULL AND gps_longitude IS NOT NULL""")
_CONTEXT = """
    seen AS (SELECT DISTINCT f.person_id, p.taken_at::DATE AS d, round_even(p.gps_latitude / 0.001::DOUBLE, 0)::BIGINT AS y,
        round_even(p.gps_longitude / 0.001::DOUBLE, 0)::BIGINT AS x FROM faces f JOIN photos p ON p.id = f.photo_id WHERE f.person_id IS NOT NULL),
    ph AS (SELECT f.id AS face_id, p.taken_at::DATE AS d, round_even(p.gps_latitude / 0.001::DOUBLE, 0)::BIGINT AS y,
        round_even(p.gps_longitude / 0.001::DOUBLE, 0)::BIGINT AS x FROM faces f JOIN photos p ON p.id = f.photo_id WHERE f.person_id IS NULL),
    cx AS (SELECT ph.face_id, r.id AS person_id,
        coalesce((CASE WHEN ph.d IS NOT NULL AND EXISTS (SELECT 1 FROM seen s WHERE s.person_id = r.id AND s.d = ph.d) THEN 0.6::DOUBLE ELSE 0 END
        + CASE WHEN ph.y IS NOT NULL AND EXISTS (SELECT 1 FROM seen s WHERE s.person_id = r.id AND abs(s.y - ph.y) <= 1 AND abs(s.x - ph.x) <= 1) THEN 0.4::DOUBLE ELSE 0 END)
        / nullif(CASE WHEN ph.d IS NOT NULL THEN 0.6::DOUBLE ELSE 0 END + CASE WHEN ph.y IS NOT NULL THEN 0.4::DOUBLE ELSE 0 END, 0), 0) AS context
        FROM ph CROSS JOIN persons r)"""
query("x9_context_scores", lambda lib: recognition.with_context(
          lib, lib.faces.filter("person_id is null").select(F.col("id").alias("face_id")).crossJoin(
              F.broadcast(lib.persons.select(F.col("id").alias("person_id"))))).withColumn("context", F.round("context", 6)),
      "WITH" + _CONTEXT + " SELECT face_id, person_id, round(context, 6) AS context FROM cx")
query("c3_stored_faces", lambda lib: recognition.gallery_candidates(lib.faces.filter("person_id is not null"), CONFIG).select("person_id", "id"), f"""
    SELECT person_id, id FROM (SELECT person_id, id, {QUALITY} AS q, row_number() OVER (PARTITION BY person_id ORDER BY {QUALITY} DESC, id) AS r
      FROM faces WHERE person_id IS NOT NULL) WHERE q >= 0.35::DOUBLE OR r = 1""")

# Recognition
query("c4_representatives", lambda lib: recognition.representatives(lib.person_embeddings, CONFIG))
query("c5_match_vectors", lambda lib: recognition.match_vectors(lib, LOOSE).groupBy("person_id", "from_gallery").agg(
          F.count(F.lit(1)).alias("n"), F.round(F.max("threshold"), 6).alias("threshold")), """
    SELECT e.person_id, true AS from_gallery, count(*) AS n, max(coalesce(p.adaptive_threshold, 0.42::DOUBLE)) AS threshold
    FROM person_embeddings e JOIN persons p ON p.id = e.person_id WHERE e.is_representative GROUP BY 1""")
query("c6_match_faces", lambda lib: recognition.match_faces(lib, LOOSE).withColumn("score", F.round("score", 6)), "WITH" + _CONTEXT + """,
    b AS (SELECT f.id AS face_id, e.person_id, max(list_cosine_similarity(f.embedding::DOUBLE[], e.embedding::DOUBLE[])) AS base,
        max(coalesce(p.adaptive_threshold, 0.42::DOUBLE)) AS thr FROM faces f JOIN person_embeddings e ON e.is_representative
        JOIN persons p ON p.id = e.person_id WHERE f.person_id IS NULL GROUP BY 1, 2),
    k AS (SELECT b.face_id, b.person_id, b.thr, b.base + CASE WHEN b.base >= b.thr - 0.10::DOUBLE THEN 0.06::DOUBLE * cx.context ELSE 0 END AS score FROM b JOIN cx USING (face_id, person_id)
        WHERE NOT EXISTS (SELECT 1 FROM recognition_feedback r WHERE r.verdict = 'reject' AND r.face_id = b.face_id AND r.person_id = b.person_id)),
    r AS (SELECT *, score - thr AS gap, row_number() OVER (PARTITION BY face_id ORDER BY (score >= thr) DESC, score DESC, person_id) AS rs,
        row_number() OVER (PARTITION BY face_id ORDER BY score - thr DESC, person_id) AS rg, bool_or(score >= thr) OVER (PARTITION BY face_id) AS hit FROM k)
    SELECT face_id, person_id, round(score, 6) AS score, CASE WHEN hit THEN 'assign' ELSE 'suggest' END AS verdict FROM r
    WHERE (hit AND rs = 1) OR (NOT hit AND rg = 1 AND gap >= -0.07::DOUBLE)""")
query("c1_dbscan", lambda lib: clustering.dbscan(lib.faces.select("id", "embedding"), 0.64, 3), """
    WITH RECURSIVE near AS (SELECT a.id AS a, b.id AS b FROM faces a JOIN faces b ON a.id = b.id
        OR list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 1 - 0.64::DOUBLE),
    core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 3),
    e AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
    t AS (SELECT id AS v, id AS x FROM core UNION SELECT t.v, e.b FROM t JOIN e ON e.a = t.x),
    c AS (SELECT v AS id, min(x) AS cluster FROM t GROUP BY v),
    border AS (SELECT n.a AS id, min(c.cluster) AS cluster FROM near n JOIN c ON c.id = n.b GROUP BY n.a)
    SELECT f.id, coalesce(c.cluster, border.cluster, -1) AS cluster FROM faces f LEFT JOIN c ON c.id = f.id LEFT JOIN border ON border.id = f.id""")
query("c2_recluster", lambda lib: clustering.recluster(lib, EngineConfig(cluster_eps=0.64)).persons.select("id", "face_count", "cover_face_id"))
query("j18_person_pairs", lambda lib: merging.person_pairs(lib, 0.30).withColumn("score", F.round("score", 6)), """
    SELECT a.person_id AS person_a, b.person_id AS person_b, round(max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS score
    FROM person_embeddings a JOIN person_embeddings b ON a.person_id < b.person_id AND b.is_representative WHERE a.is_representative
    GROUP BY 1, 2 HAVING max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) >= 0.30::DOUBLE""")
query("c9_merge_scan", lambda lib: merging.scan_for_merges(lib, LOOSE)[0].person_merge_suggestions.withColumn("score", F.round("score", 6)))
query("c8_update_people", lambda lib: recognition.update_people(lib, LOOSE)[0].persons.select("id", "display_name", "face_count"))

# Knowledge
query("c15_export_people", lambda lib: knowledge.export_people(lib).select("name", F.posexplode("faces").alias("pos", "f")).select("name", "pos", "f.*"), """
    SELECT r.display_name AS name, (row_number() OVER (PARTITION BY r.display_name ORDER BY r.id, f.id) - 1)::INT AS pos, p.file_hash, f.bbox_x, f.bbox_y, f.bbox_w, f.bbox_h
    FROM persons r JOIN faces f ON f.person_id = r.id JOIN photos p ON p.id = f.photo_id WHERE r.display_name IS NOT NULL""")
query("c15_export_favorites", lambda lib: knowledge.export_favorites(lib), "SELECT file_hash FROM photos WHERE is_favorite")
query("c15_export_feedback", lambda lib: knowledge.export_feedback(lib), """
    SELECT p.file_hash, f.bbox_x, f.bbox_y, f.bbox_w, f.bbox_h, r.display_name AS person, v.verdict FROM recognition_feedback v
      JOIN faces f ON f.id = v.face_id JOIN photos p ON p.id = f.photo_id JOIN persons r ON r.id = v.person_id WHERE r.display_name IS NOT NULL""")
query("j20_find_faces", lambda lib: knowledge.find_faces(lib, knowledge.face_keys(lib).select(*knowledge.FACE_KEY).distinct()), """
    SELECT p.file_hash, f.bbox_x, f.bbox_y, f.bbox_w, f.bbox_h, min(f.id) AS face_id FROM faces f JOIN photos p ON p.id = f.photo_id
    GROUP BY ALL""")

# Changes
query("m3_merge_persons", lambda lib: mutations.merge_persons(lib, 3, 5, CONFIG).persons.select("id", "display_name", "face_count"), """
    SELECT id, display_name, (CASE WHEN id = 5 THEN (SELECT count(*) FROM faces WHERE person_id IN (3, 5)) ELSE face_count END)::INT AS face_count
    FROM persons WHERE id <> 3""")
query("m2_delete_person", lambda lib: mutations.delete_persons(lib, lib.persons.filter("id = 4").select("id")).faces.select("id", "person_id"),
      "SELECT id, CASE WHEN person_id = 4 THEN NULL ELSE person_id END AS person_id FROM faces")
query("m5_record_feedback", lambda lib: mutations.record_feedback(
          lib, lib.recognition_feedback.filter("verdict = 'reject'").select("face_id", ((F.col("face_id") + 3) % 10).alias("person_id"),
                                                      F.lit("confirm").alias("verdict"), F.lit(NOW).cast("timestamp_ntz").alias("created_at"))
      ).recognition_feedback.select("face_id", "person_id", "verdict"),
      "SELECT face_id, person_id, 'confirm' AS verdict FROM recognition_feedback")
query("m6_stale_suggestions", lambda lib: recognition.drop_stale_suggestions(lib).recognition_suggestions,
      "SELECT * FROM recognition_suggestions WHERE face_id IN (SELECT id FROM faces WHERE person_id IS NULL)")
query("m7_reject_merge", lambda lib: mutations.reject_merge(lib, 3, 0).person_merge_rejections,
      "SELECT person_a, person_b FROM person_merge_rejections UNION SELECT 0, 3")
query("m8_set_favorite", lambda lib: mutations.set_photo_values(
          lib, lib.photos.select("id", (~F.col("is_favorite")).alias("value")), "is_favorite").photos.select("id", "is_favorite"),
      "SELECT id, NOT is_favorite AS is_favorite FROM photos")
query("m9_mark_duplicates", lambda lib: mutations.mark_duplicates(lib, 2, [2, 9, 40]).photos.select("id", "duplicate_of"),
      "SELECT id, CASE WHEN id IN (9, 40) THEN 2 WHEN id = 2 THEN NULL ELSE duplicate_of END AS duplicate_of FROM photos")
query("m10_add_to_album", lambda lib: mutations.add_to_album(lib, 4, [9, 2, 9, 14], NOW)[0].album_photos.select("album_id", "photo_id"),
      "SELECT album_id, photo_id FROM album_photos UNION SELECT 4, unnest([9, 2, 14])")
query("m11_upsert_clip", lambda lib: mutations.upsert_clip(
          lib, lib.clip_embeddings.withColumn("model", F.concat("model", F.lit("-next")))).clip_embeddings.select("photo_id", "model"),
      "SELECT photo_id, model || '-next' AS model FROM clip_embeddings")
query("s7_insert_photos", lambda lib: mutations.insert_photos(
          lib, lib.photos.select(F.when(F.col("is_favorite"), F.concat(F.lit("/new"), "file_path")).otherwise(F.col("file_path")).alias("file_path"),
                               "file_hash", "file_size"), NOW).photos.select("id", "file_path"), """
    SELECT id, file_path FROM photos UNION ALL SELECT (SELECT max(id) FROM photos) + row_number() OVER (ORDER BY '/new' || file_path COLLATE "C"), '/new' || file_path
    FROM photos WHERE is_favorite""".replace(' COLLATE "C"', ""))
def _reset_counts(lib: Library) -> DataFrame:
    """Rows of each table that has any, before and after a reset."""
    empty = mutations.reset_library(lib)
    parts = [lib[t].select(F.lit(t).alias("name"), F.lit(1).alias("b"), F.lit(0).alias("a")) for t in SCHEMAS]
    parts += [empty[t].select(F.lit(t).alias("name"), F.lit(0).alias("b"), F.lit(1).alias("a")) for t in SCHEMAS]
    return reduce(DataFrame.union, parts).groupBy("name").agg(F.sum("b").alias("before"), F.sum("a").alias("after"))


query("m12_reset", _reset_counts, " UNION ALL ".join(
    f"SELECT '{t}' AS name, count(*) AS before, 0::BIGINT AS after FROM {t} HAVING count(*) > 0" for t in SCHEMAS))

# Presentation
query("x17_presentation", lambda lib: lib.photos.select(
          "id", scalars.human_bytes(F.col("file_size") * F.pow(F.lit(997), F.col("id") % 5).cast("long")).alias("size"), scalars.human_duration(F.col("file_size")).alias("duration")), """
    SELECT id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0::DOUBLE) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576.0::DOUBLE)
        WHEN b < 1099511627776 THEN printf('%.1f GB', b / 1073741824.0::DOUBLE) WHEN b < 1125899906842624 THEN printf('%.1f TB', b / 1099511627776.0::DOUBLE)
        ELSE printf('%.1f PB', b / 1125899906842624.0::DOUBLE) END AS size,
      CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS duration
    FROM (SELECT id, file_size * cast(pow(997, id % 5) AS BIGINT) AS b, file_size AS s FROM photos)""")
