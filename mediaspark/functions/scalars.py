"""Scalar column functions: hashes, face quality, thresholds, context, text and presentation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EngineConfig


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit fingerprints."""
    return F.bit_count(a.bitwiseXOR(b))


def hash_band(h: Column, band: int) -> Column:
    """One of the eight bytes of a fingerprint, also for negative longs."""
    return F.shiftrightunsigned(h, 8 * band).bitwiseAND(F.lit(255).cast("long"))


def to_signed(value: int) -> int:
    """An unsigned 64-bit number as the signed long with the same bits."""
    return value - (1 << 64) if value >= 1 << 63 else value


def from_signed(value: int) -> int:
    return value + (1 << 64) if value < 0 else value


def _clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def _ramp(x: Column, low: float, high: float) -> Column:
    return _clamp((x - low) / (high - low))


def face_quality(det_score: Column, width: Column, height: Column, sharpness: Column | None = None) -> Column:
    """0 to 1: detector score and size, and sharpness where it is known."""
    score = _clamp(F.coalesce(det_score.cast("double"), F.lit(0.0)))
    size = _ramp(F.least(width, height).cast("double"), 40.0, 112.0)
    plain = 0.5 * score + 0.5 * size
    if sharpness is None:
        return plain
    sharp = 0.4 * score + 0.4 * size + 0.2 * _ramp(sharpness.cast("double"), 100.0, 500.0)
    return F.when(sharpness.isNull(), plain).otherwise(sharp)


def quality_band(quality: Column) -> Column:
    """excellent, good, store or ignore."""
    return (
        F.when(quality >= 0.8, "excellent").when(quality >= 0.6, "good").when(quality >= 0.35, "store").otherwise("ignore")
    )


def adaptive_threshold(consistency: Column, reps: Column, config: EngineConfig) -> Column:
    """A person's own match threshold: looser for scattered faces, stricter for tight ones; null with few representatives."""
    g, low, high = config.face_match_threshold, config.adaptive_threshold_min, config.adaptive_threshold_max
    value = _clamp(g + (consistency - 0.5) * (high - low), low, high)
    value = F.when(reps < config.adaptive_strict_min_reps, F.least(value, F.lit(g))).otherwise(value)
    return F.when(reps >= config.adaptive_threshold_min_reps, value)


#: Degrees in a cell of the place grid.
CELL = 0.001


def gps_cell(latitude: Column, longitude: Column) -> Column:
    """struct(y, x) of the grid cell, half to even; null unless both are finite."""
    finite = latitude.isNotNull() & longitude.isNotNull()
    for c in (latitude, longitude):
        finite = finite & ~F.isnan(c) & (F.abs(c) < float("inf"))
    cell = F.struct(
        F.rint(latitude / CELL).cast("long").alias("y"), F.rint(longitude / CELL).cast("long").alias("x")
    )
    return F.when(finite, cell)


def neighbour_cells(cell: Column) -> Column:
    """The cell and its eight neighbours."""
    return F.array(
        *[F.struct((cell["y"] + dy).alias("y"), (cell["x"] + dx).alias("x")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    )


def context_score(day_known: Column, same_day: Column, place_known: Column, same_place: Column) -> Column:
    """0.6 for the day and 0.4 for the place, over the signals that the photo has; 0 without any."""
    got = F.when(day_known & same_day, 0.6).otherwise(0.0) + F.when(place_known & same_place, 0.4).otherwise(0.0)
    most = F.when(day_known, 0.6).otherwise(0.0) + F.when(place_known, 0.4).otherwise(0.0)
    return F.coalesce(F.try_divide(got, most), F.lit(0.0))


def clamp_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """struct(x, y, w, h) of whole pixels inside the image; null for a corner that is no number, an unknown size or an empty box."""
    at = lambda v, size: F.greatest(F.lit(0), F.least(F.rint(v).cast("int"), size - 1))
    bad = reduce(lambda a, b: a | b, [v.isNull() | F.isnan(v) for v in (x1, y1, x2, y2)], width.isNull() | height.isNull())
    left, top, right, bottom = at(x1, width), at(y1, height), at(x2, width), at(y2, height)
    box = F.struct(left.alias("x"), top.alias("y"), (right - left).alias("w"), (bottom - top).alias("h"))
    return F.when(~bad & (right > left) & (bottom > top), box)


def clean_name(name: Column) -> Column:
    """Trimmed; null where nothing is left."""
    return F.nullif(F.trim(name), F.lit(""))


def group_key(ids: Column) -> Column:
    """Sorted ids joined by '-'."""
    return F.array_join(F.transform(F.array_sort(ids), lambda x: x.cast("string")), "-")


def subsequence_match(query: str, text: Column) -> Column:
    """Whether the query's characters, spaces left out, stand in the text in this order, letter case aside."""
    chars = [c for c in query.lower() if not c.isspace()]
    if not chars:
        return F.lit(True)
    return F.lower(text).rlike("(?s)" + ".*".join("\\Q" + c + "\\E" for c in chars))


def human_bytes(n: Column) -> Column:
    """A size in B, KB, MB, GB, TB or PB with one decimal over bytes, half to even; the sign doesn't choose the unit."""
    amount = lambda power: F.format_string("%.1f", F.bround(n / F.lit(float(1024**power)), 1))
    out = F.concat(amount(5), F.lit(" PB"))
    for power, unit in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB")):
        part = F.concat(amount(power), F.lit(f" {unit}"))
        out = F.when(F.abs(n) < 1024 ** (power + 1), part).otherwise(out)
    return F.when(F.abs(n) < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).otherwise(out)


def human_duration(seconds: Column) -> Column:
    """M:SS, or H:MM:SS from an hour on; whole seconds, none under 0."""
    s = F.greatest(seconds.cast("long"), F.lit(0).cast("long"))
    hours = F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
    minutes = F.format_string("%d:%02d", F.floor(s / 60), s % 60)
    return F.when(seconds.isNull(), None).when(s >= 3600, hours).otherwise(minutes)


def greeting(hour: Column) -> Column:
    """Good morning before 12, Good afternoon before 18, else Good evening."""
    return F.when(hour < 12, "Good morning").when(hour < 18, "Good afternoon").otherwise("Good evening")


def seen_line(photos: Column, first: Column, last: Column) -> Column:
    """How many photos show a person, the month of the first and the day of the last, as far as they are known."""
    shown = F.concat(F.format_string("%,d", F.coalesce(photos, F.lit(0)).cast("long")), F.lit(" photos"))
    since = F.concat(F.lit("First seen "), F.date_format(first, "MMM yyyy"))
    until = F.concat(F.lit("Last seen "), F.date_format(last, "MMM dd, yyyy"))
    return F.concat_ws("   ·   ", shown, since, until)


def year_span(first: Column, last: Column) -> Column:
    """2019 or 2019 – 2024; null without dates."""
    a, b = F.year(first), F.year(last)
    return F.when(a == b, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit(" – "), b.cast("string")))


def eta_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    """Seconds left at the pace so far; null before the first item."""
    return F.try_divide((total - done) * elapsed, done)


def parse_exif_datetime(value: Column) -> Column:
    """'2021:07:04 12:34:56' as a timestamp, else null."""
    text = F.trim(value)
    shaped = text.rlike(r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$")
    return F.when(shaped, F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz"))


def dms_to_degrees(dms: Column, ref: Column) -> Column:
    """Degrees from [degrees, minutes, seconds]; south and west are negative; null unless there are three finite parts."""
    fine = F.size(dms) == 3
    for i in range(3):
        x = F.get(dms, F.lit(i))
        fine = fine & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    value = F.get(dms, F.lit(0)) + F.get(dms, F.lit(1)) / 60 + F.get(dms, F.lit(2)) / 3600
    sign = F.when(F.upper(F.trim(ref)).isin("S", "W"), -1.0).otherwise(1.0)
    return F.when(fine, sign * value)


def dhash_bits(pixels: Column) -> Column:
    """64-bit difference hash of 72 grey values (eight rows of nine): a bit is 1 where left > right, highest bit first."""
    bit = lambda i: F.when(
        F.element_at(pixels, i + F.floor(i / 8).cast("int") + 1) > F.element_at(pixels, i + F.floor(i / 8).cast("int") + 2), 1
    ).otherwise(0).cast("long")
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), bit)
    value = F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b))
    return F.when(F.size(pixels) == 72, value)
