import math

import pytest
from pyspark.sql import functions as F

from mediaspark.config import EngineConfig, Preferences, env_float, env_int
from mediaspark.functions import scalars as s
from mediaspark.functions import vectors as v


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def vec(*x):
    return F.array(*[F.lit(float(i)) for i in x])


def test_vectors(spark):
    r = one(
        spark, unit=v.l2_normalize(vec(3, 4)), zero=v.l2_normalize(vec(0, 0)), cos=v.cosine(vec(1, 0), vec(1, 1)),
        none=v.cosine(vec(0, 0), vec(1, 1)), far=v.cosine_distance(vec(1, 0), vec(-1, 0)), run=v.running_centroid(vec(2, 0), F.lit(3), vec(0, 3)),
    )
    assert r.unit == [0.6, 0.8] and r.zero == [0.0, 0.0] and r.none is None and r.far == 2.0
    assert r.cos == pytest.approx(math.sqrt(0.5)) and r.run == pytest.approx([math.sqrt(0.5)] * 2)


def test_consistency(spark):
    rows = [(1, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0]), (3, [1.0])]
    got = {r.k: r for r in v.consistency(spark.createDataFrame(rows, "k int, embedding array<float>"), ["k"]).collect()}
    assert got[1].consistency == pytest.approx(1) and got[2].consistency == 0 and got[3].consistency == 1 and got[2].n == 2


def test_hashes(spark):
    for x in (0, 1, 2**63 - 1, 2**63, 2**63 + 1, 2**64 - 1):
        assert s.from_signed(s.to_signed(x)) == x
    a, b = s.to_signed(0xA5A5A5A5A5A5A5A5), s.to_signed(0xA5A5A5A5A5A5A5A6)
    r = one(spark, d=s.hamming(F.lit(a), F.lit(b)), top=s.hash_band(F.lit(a), 7), low=s.hash_band(F.lit(b), 0))
    assert (r.d, r.top, r.low) == (2, 0xA5, 0xA6)
    pixels = F.array(*[F.lit(9 - i % 9) for i in range(72)])
    assert one(spark, h=s.dhash_bits(pixels)).h == -1


def test_quality_and_thresholds(spark):
    q = lambda d, w, h, sharp=None: s.face_quality(F.lit(d), F.lit(w), F.lit(h), None if sharp is None else F.lit(sharp))
    r = one(spark, small=q(0.9, 10, 10), big=q(1.0, 120, 120), weak=q(0.2, 20, 20), sharp=q(1.0, 200, 200, 300.0), none=q(None, 200, 200))
    assert (r.small, r.big, r.weak, r.sharp, r.none) == pytest.approx((0.45, 1.0, 0.1, 0.9, 0.5))
    c = EngineConfig()
    t = lambda k, n: s.adaptive_threshold(F.lit(k), F.lit(n), c)
    r = one(spark, few=t(0.9, 2), tight=t(1.0, 8), strict=t(1.0, 4), loose=t(0.0, 8))
    assert r.few is None and r.tight == 0.62 and r.strict == 0.55 and r.loose == pytest.approx(0.465)
    bands = [one(spark, b=s.quality_band(F.lit(x))).b for x in (0.8, 0.6, 0.35, 0.1)]
    assert bands == ["excellent", "good", "store", "ignore"]


def test_context(spark):
    nan = F.lit(float("nan"))
    r = one(spark, c=s.gps_cell(F.lit(37.0125), F.lit(-122.0)), bad=s.gps_cell(nan, F.lit(1.0)), n=F.size(s.neighbour_cells(s.gps_cell(F.lit(1.0), F.lit(1.0)))))
    assert (r.c.y, r.c.x) == (37012, -122000) and r.bad is None and r.n == 9
    t, f = F.lit(True), F.lit(False)
    r = one(spark, both=s.context_score(t, t, t, t), day=s.context_score(t, t, t, f), only=s.context_score(t, t, f, f), no=s.context_score(f, f, f, f))
    assert (r.both, r.day, r.only, r.no) == pytest.approx((1.0, 0.6, 1.0, 0.0))


def test_texts_and_boxes(spark):
    box = lambda *x: s.clamp_box(*[F.lit(float(i)) for i in x], F.lit(100), F.lit(50))
    r = one(
        spark, name=s.clean_name(F.lit("  Ann ")), blank=s.clean_name(F.lit("  ")), key=s.group_key(F.array(F.lit(10), F.lit(9))),
        hit=s.subsequence_match("o.s", F.lit("Open .settings")), miss=s.subsequence_match("zz", F.lit("z")), box=box(-5, 2.6, 300, 40), bad=box(float("nan"), 0, 1, 1),
        bytes=s.human_bytes(F.lit(1536)), b=s.human_bytes(F.lit(12)), time=s.human_duration(F.lit(3725)), eta=s.eta_seconds(F.lit(2), F.lit(6), F.lit(10.0)),
        none=s.eta_seconds(F.lit(0), F.lit(6), F.lit(10.0)), span=s.year_span(F.to_date(F.lit("2019-01-01")), F.to_date(F.lit("2024-01-01"))),
        short=s.human_duration(F.lit(65)), day=s.human_duration(F.lit(90_000.9)), under=s.human_duration(F.lit(-3)), zero=s.human_duration(F.lit(9)),
        tb=s.human_bytes(F.lit(5 << 40)), pb=s.human_bytes(F.lit(3 << 50)), huge=s.human_bytes(F.lit(3 << 60)), minus=s.human_bytes(F.lit(-2048)),
        am=s.greeting(F.lit(11)), pm=s.greeting(F.lit(12)), late=s.greeting(F.lit(18)),
        seen=s.seen_line(F.lit(1234), F.to_timestamp(F.lit("2019-03-05 01:00:00")), F.to_timestamp(F.lit("2024-01-09 01:00:00"))),
        unseen=s.seen_line(F.lit(0), F.lit(None).cast("timestamp"), F.lit(None).cast("timestamp")),
    )
    assert r.name == "Ann" and r.blank is None and r.key == "9-10" and r.hit and not r.miss
    assert tuple(r.box) == (0, 3, 99, 37) and r.bad is None
    assert (r.bytes, r.b, r.time, r.eta, r.none, r.span) == ("1.5 KB", "12 B", "1:02:05", 20.0, None, "2019 – 2024")
    assert (r.short, r.day, r.under, r.zero) == ("1:05", "25:00:00", "0:00", "0:09")
    assert (r.tb, r.pb, r.huge, r.minus) == ("5.0 TB", "3.0 PB", "3072.0 PB", "-2.0 KB")
    assert (r.am, r.pm, r.late) == ("Good morning", "Good afternoon", "Good evening")
    assert (r.seen, r.unseen) == ("1,234 photos   ·   First seen Mar 2019   ·   Last seen Jan 09, 2024", "0 photos")


def test_exif_values(spark):
    dms = F.array(F.lit(37.0), F.lit(46.0), F.lit(30.0))
    r = one(
        spark, good=s.parse_exif_datetime(F.lit(" 2021:07:04 12:34:56 ")), bad=s.parse_exif_datetime(F.lit("2021-07-04")),
        north=s.dms_to_degrees(dms, F.lit("N")), west=s.dms_to_degrees(dms, F.lit(" w")), short=s.dms_to_degrees(F.array(F.lit(1.0)), F.lit("N")),
    )
    assert str(r.good) == "2021-07-04 12:34:56" and r.bad is None and r.short is None
    assert r.north == pytest.approx(37.775) and r.west == pytest.approx(-37.775)


def test_config(tmp_path):
    env = {"MEDIASPARK_CLUSTER_EPS": "0.4", "MEDIASPARK_CLUSTER_MIN_SAMPLES": "x", "MEDIASPARK_CLIP_MODEL": " m9 "}
    c = EngineConfig.from_env(env)
    assert (c.cluster_eps, c.cluster_min_samples, c.clip_model) == (0.4, 3, "m9")
    assert env_int({"A": "7"}, "A", 1) == 7 and env_float({"A": "nan"}, "A", 1.5) == 1.5
    p, seen = Preferences(str(tmp_path / "a/p.json")), []
    p.subscribe(lambda k, x: seen.append((k, x)))
    p.set("cluster_eps", 0.3)
    for key, value in (("cluster_eps", 3), ("cluster_min_samples", 1.5), ("clip_model", " "), ("merge_auto_threshold", True)):
        with pytest.raises(ValueError):
            p.set(key, value)
    with pytest.raises(KeyError):
        p.set("nothing", 1)
    again = Preferences(p.path)
    assert again.get("cluster_eps") == 0.3 and again.effective(env).cluster_eps == 0.3 and seen == [("cluster_eps", 0.3)]
    (tmp_path / "a/p.json").write_text('{"cluster_eps": 9, "x": 1, "phash_max_distance": 4}')
    assert Preferences(p.path).values == {"phash_max_distance": 4}
    again.reset()
    assert Preferences(p.path).values == {}
