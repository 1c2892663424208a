"""Image files: listing, identity, EXIF facts, fingerprints, and pixel models behind injectable functions."""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.scalars import clamp_box, dms_to_degrees, parse_exif_datetime
from .jpeg import jpeg


def image_files(spark: SparkSession, root: str, config: EngineConfig = EngineConfig(), content: bool = True) -> DataFrame:
    """Files below a folder whose suffix, letter case aside, is an image's: path, modificationTime, length, content.

    A file that can't be read is left out, unless `content` is not asked for, as a listing names it still.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(root)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    files = files.filter(suffix.isin(list(config.image_suffixes)))
    return files if content else files.drop("content")


def with_hash(files: DataFrame) -> DataFrame:
    """file_hash: SHA-256 of the content."""
    return files.withColumn("file_hash", F.sha2("content", 256))


# EXIF tags.
_MAKE, _MODEL, _ORIENTATION, _DATETIME = 0x010F, 0x0110, 0x0112, 0x0132
_EXIF_IFD, _GPS_IFD, _ORIGINAL = 0x8769, 0x8825, 0x9003
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def _tiff(data: bytes) -> dict:
    """Tags of the first directory, the EXIF one and the GPS one of a TIFF block."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        return {}

    def directory(at: int) -> dict:
        out = {}
        (n,) = struct.unpack_from(order + "H", data, at)
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            size = _SIZES.get(kind, 0) * count
            if not size:
                continue
            where = at + 10 + 12 * i
            if size > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            raw = data[where : where + size]
            if len(raw) < size:
                continue
            if kind == 2:
                out[tag] = raw.split(b"\0")[0].decode("latin-1")
            elif kind in (5, 10):
                parts = struct.unpack(order + ("II" if kind == 5 else "ii") * count, raw)
                out[tag] = [a / b if b else float("nan") for a, b in zip(parts[::2], parts[1::2])]
            elif kind in (3, 4, 9):
                values = struct.unpack(order + {3: "H", 4: "I", 9: "i"}[kind] * count, raw)
                out[tag] = values[0] if count == 1 else list(values)
        return out

    (first,) = struct.unpack_from(order + "I", data, 4)
    tags = directory(first)
    exif = directory(tags[_EXIF_IFD]) if isinstance(tags.get(_EXIF_IFD), int) else {}
    gps = directory(tags[_GPS_IFD]) if isinstance(tags.get(_GPS_IFD), int) else {}
    return {"main": tags, "exif": exif, "gps": gps}


def read_facts(content: bytes) -> dict:
    """width, height, format, orientation, make, model, taken (text), latitude and longitude parts; None where unknown."""
    out: dict = dict.fromkeys(
        ("width", "height", "format", "orientation", "make", "model", "taken", "lat", "lat_ref", "lon", "lon_ref")
    )
    try:
        if content[:8] == b"\x89PNG\r\n\x1a\n":
            out["format"] = "PNG"
            out["width"], out["height"] = struct.unpack_from(">II", content, 16)
        elif content[:2] == b"BM":
            out["format"] = "BMP"
            out["width"], height = struct.unpack_from("<ii", content, 18)
            out["height"] = abs(height)
        elif content[:6] in (b"GIF87a", b"GIF89a"):
            out["format"] = "GIF"
            out["width"], out["height"] = struct.unpack_from("<HH", content, 6)
        elif content[:2] == b"\xff\xd8":
            at = 2
            while at + 4 <= len(content) and content[at] == 0xFF:
                marker = content[at + 1]
                (size,) = struct.unpack_from(">H", content, at + 2)
                body = content[at + 4 : at + 2 + size]
                if marker == 0xE1 and body[:6] == b"Exif\0\0":
                    tags = _tiff(body[6:])
                    main, exif, gps = (tags.get(k, {}) for k in ("main", "exif", "gps"))
                    out["orientation"] = main.get(_ORIENTATION)
                    out["make"], out["model"] = main.get(_MAKE), main.get(_MODEL)
                    out["taken"] = exif.get(_ORIGINAL) or main.get(_DATETIME)
                    out["lat_ref"], out["lat"], out["lon_ref"], out["lon"] = (gps.get(k) for k in (1, 2, 3, 4))
                elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    out["format"] = "JPEG"
                    out["height"], out["width"] = struct.unpack_from(">HH", body, 1)
                    break
                elif marker == 0xDA:
                    break
                at += 2 + size
    except (struct.error, IndexError, TypeError, ValueError):
        pass  # a broken file keeps what was read: identity is kept, facts are null
    return out


_FACTS = (
    "file_path string, file_hash string, file_size long, file_mtime timestamp, width int, height int, format string, "
    "orientation short, make string, model string, taken string, lat array<double>, lat_ref string, lon array<double>, lon_ref string"
)


def photo_metadata(files: DataFrame) -> DataFrame:
    """Rows for insert_photos(): identity always, facts where the bytes can be read."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            facts = pd.DataFrame([read_facts(c) for c in pdf["content"]], index=pdf.index)
            out = pdf.drop(columns="content").join(facts)
            for c in ("lat", "lon"):
                out[c] = [v if isinstance(v, list) else None for v in out[c]]
            for c in ("width", "height", "orientation"):
                out[c] = [int(v) if isinstance(v, int) or (isinstance(v, float) and v == v) else None for v in out[c]]
                out[c] = out[c].astype("Int64")
            yield out

    source = with_hash(files).select(
        F.col("path").alias("file_path"), "file_hash", F.col("length").alias("file_size"), F.col("modificationTime").alias("file_mtime"), "content"
    )
    rows = source.mapInPandas(read, _FACTS)
    return rows.select(
        "file_path", "file_hash", "file_size", F.col("file_mtime").cast("timestamp_ntz").alias("file_mtime"), "width", "height", "format",
        "orientation", F.nullif(F.trim("make"), F.lit("")).alias("camera_make"), F.nullif(F.trim("model"), F.lit("")).alias("camera_model"),
        parse_exif_datetime(F.col("taken")).alias("taken_at"),
        dms_to_degrees(F.col("lat"), F.col("lat_ref")).alias("gps_latitude"),
        dms_to_degrees(F.col("lon"), F.col("lon_ref")).alias("gps_longitude"),
    )


def _lanczos(source: int, target: int, a: int = 3) -> np.ndarray:
    """target x source weights of a Lanczos reduction."""
    scale = max(1.0, source / target)
    centre = (np.arange(target) + 0.5) * source / target
    x = (np.arange(source)[None, :] + 0.5 - centre[:, None]) / scale
    w = np.where(np.abs(x) < a, np.sinc(x) * np.sinc(x / a), 0.0)
    return w / w.sum(1, keepdims=True)


def dhash(grey: np.ndarray) -> int:
    """Signed 64-bit difference hash of a grey image: eight rows of nine, a bit is 1 where left > right."""
    small = _lanczos(grey.shape[0], 8) @ grey.astype(np.float64) @ _lanczos(grey.shape[1], 9).T
    small = np.clip(np.rint(small), 0, 255)
    bits = (small[:, :-1] > small[:, 1:]).reshape(-1)
    value = int("".join("1" if b else "0" for b in bits), 2)
    return value - (1 << 64) if value >= 1 << 63 else value


#: Stands for a photo that can't be hashed.
UNHASHABLE = -1


def photo_hashes(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, phash) of all images that Spark's image source finds; UNHASHABLE where it can't decode one."""
    images = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(root).select("image.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for h, w, c, data in zip(pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"]):
                if h <= 0 or w <= 0:
                    out.append(UNHASHABLE)
                    continue
                px = np.frombuffer(data, np.uint8).reshape(h, w, c).astype(np.float64)
                grey = px[:, :, 0] if c == 1 else px[:, :, :3] @ np.array([0.114, 0.587, 0.299])  # stored blue first
                out.append(dhash(grey))
            yield pd.DataFrame({"file_path": pdf["origin"], "phash": out})

    return images.mapInPandas(run, "file_path string, phash long")


def oriented(px: np.ndarray, orientation: int | None) -> np.ndarray:
    """Pixels turned upright by the EXIF orientation, 1 to 8; any other value leaves them as they are."""
    turns = {
        2: lambda p: p[:, ::-1], 3: lambda p: p[::-1, ::-1], 4: lambda p: p[::-1], 5: lambda p: p.transpose(1, 0, 2),
        6: lambda p: p[::-1].transpose(1, 0, 2), 7: lambda p: p[::-1, ::-1].transpose(1, 0, 2), 8: lambda p: p[:, ::-1].transpose(1, 0, 2),
    }
    return turns.get(orientation, lambda p: p)(px)


def shrunk(px: np.ndarray, size: int) -> np.ndarray:
    """Pixels whose longer side is `size` at most, with the proportions kept; small images stay."""
    h, w = px.shape[:2]
    scale = size / max(h, w)
    if scale >= 1:
        return px
    rows, cols = _lanczos(h, max(1, round(h * scale))), _lanczos(w, max(1, round(w * scale)))
    out = np.einsum("ij,jkc->ikc", rows, px.astype(np.float64))
    return np.clip(np.rint(np.einsum("lk,ikc->ilc", cols, out)), 0, 255).astype(np.uint8)


def _rgb(h: int, w: int, c: int, data: bytes) -> np.ndarray | None:
    if h <= 0 or w <= 0:
        return None
    px = np.frombuffer(data, np.uint8).reshape(h, w, c)
    return np.repeat(px, 3, axis=2) if c == 1 else px[:, :, 2::-1]  # stored blue first


def _decoded(spark: SparkSession, root: str) -> DataFrame:
    images = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(root)
    return images.select(_plain(F.col("image.origin")).alias("file_path"), "image.height", "image.width", "image.nChannels", "image.data")


def _plain(path):
    """A local path as one source writes it; the image source has more slashes."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def thumbnails(photos: DataFrame, root: str, size: int = 320) -> DataFrame:
    """(id, image) for photos (id, file_path, orientation) below a folder: upright JPEG images of at most `size` pixels a side.

    image is null where a photo can't be decoded.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                px = _rgb(r.height, r.width, r.nChannels, r.data)
                out.append(None if px is None else jpeg(shrunk(oriented(px, r.orientation), size)))
            yield pd.DataFrame({"id": pdf["id"], "image": out})

    rows = photos.select("id", _plain(F.col("file_path")).alias("file_path"), F.coalesce("orientation", F.lit(1)).cast("int").alias("orientation"))
    return rows.join(_decoded(photos.sparkSession, root), "file_path").drop("file_path").mapInPandas(run, "id long, image binary")


def face_crops(faces: DataFrame, root: str) -> DataFrame:
    """(crop_path, image) for faces (crop_path, file_path, boxes) below a folder: the box cut out, as a JPEG image."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                px = _rgb(r.height, r.width, r.nChannels, r.data)
                cut = None if px is None else px[r.bbox_y : r.bbox_y + r.bbox_h, r.bbox_x : r.bbox_x + r.bbox_w]
                out.append(None if cut is None or not cut.size else jpeg(cut))
            yield pd.DataFrame({"crop_path": pdf["crop_path"], "image": out})

    rows = faces.select("crop_path", _plain(F.col("file_path")).alias("file_path"), "bbox_x", "bbox_y", "bbox_w", "bbox_h")
    return rows.join(_decoded(faces.sparkSession, root), "file_path").drop("file_path").mapInPandas(run, "crop_path string, image binary")


def write_images(images: DataFrame, folder: str, name: str) -> DataFrame:
    """Write each image of (NAME, image) as a file of a folder that all tasks share: (NAME, path), path null for a null image.

    A file appears under its name once it is whole, so a task that is run again does no harm.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for pdf in batches:
            paths = []
            for key, image in zip(pdf[name], pdf["image"]):
                if image is None:
                    paths.append(None)
                    continue
                path = os.path.join(folder, f"{os.path.splitext(str(key))[0]}.jpg")
                with tempfile.NamedTemporaryFile(dir=folder, delete=False) as f:
                    f.write(image)
                os.replace(f.name, path)
                paths.append(path)
            yield pd.DataFrame({name: pdf[name], "path": paths})

    kind = images.schema[name].dataType.simpleString()
    return images.select(name, "image").mapInPandas(run, f"{name} {kind}, path string")


class FaceDetector(Protocol):
    def __call__(self, content: bytes) -> list[tuple[float, float, float, float, float, list[float]]]:
        """(x1, y1, x2, y2, score, vector) of each face."""


def _isolated(make: Callable[[], Callable], pdf: pd.DataFrame, state: dict):
    """(id, result, status) for each row; an error spoils its own row alone."""
    if "f" not in state:
        state["f"] = make()
    for i, content in zip(pdf["id"], pdf["content"]):
        try:
            result = state["f"](content)
            yield i, result, "ok" if result is not None else "unreadable"
        except Exception as error:  # a model may raise anything
            yield i, None, f"error: {type(error).__name__}"


def run_model(photos: DataFrame, make: Callable[[], Callable], result: str) -> DataFrame:
    """(id, result, status) of a pixel or text model over photos (id, content); make() builds it once in each task.

    Photos that fail are told apart by status and stop nothing; None means unreadable.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        for pdf in batches:
            rows = list(_isolated(make, pdf, state))
            yield pd.DataFrame(rows, columns=["id", "result", "status"])

    return photos.select("id", "content").mapInPandas(run, f"id long, result {result}, status string")


def embed_images(photos: DataFrame, make: Callable[[], Callable], model: str, version: int, dim: int) -> DataFrame:
    """Rows for upsert_clip() from an encoder: vectors of the right width and finite elements, at length 1."""
    from ..functions.vectors import l2_normalize

    rows = run_model(photos, make, "array<double>").filter(F.col("status") == "ok")
    good = (F.size("result") == dim) & ~F.exists("result", lambda x: x.isNull() | F.isnan(x))
    return rows.filter(good).select(
        F.col("id").alias("photo_id"), l2_normalize(F.col("result")).cast("array<float>").alias("embedding"),
        F.lit(model).alias("model"), F.lit(version).alias("version"),
    )


def recognise_texts(photos: DataFrame, make: Callable[[], Callable]) -> DataFrame:
    """(id, value) for set_photo_values(): lines joined and trimmed; '' for none, and for a photo that can't be read."""
    rows = run_model(photos, make, "array<string>")
    return rows.select("id", F.coalesce(F.trim(F.array_join("result", "\n")), F.lit("")).alias("value"))


def detect_faces(photos: DataFrame, make: Callable[[], FaceDetector], config: EngineConfig) -> DataFrame:
    """Faces (photo_id, boxes, det_score, embedding, crop_path) over the score floor, with finite boxes and vectors.

    photos: id, content, width, height.
    """
    kind = "array<struct<x1:double,y1:double,x2:double,y2:double,score:double,vector:array<double>>>"
    found = run_model(photos, make, kind).filter(F.col("status") == "ok").select("id", F.posexplode("result").alias("k", "f"))
    sized = found.join(photos.select("id", "width", "height"), "id")
    box = clamp_box(*[F.col(f"f.{c}") for c in ("x1", "y1", "x2", "y2")], F.col("width"), F.col("height"))
    bad = F.exists("f.vector", lambda x: x.isNull() | F.isnan(x)) | (F.size("f.vector") == 0)
    return (
        sized.withColumn("box", box)
        .filter(F.col("box").isNotNull() & ~bad & (F.col("f.score") >= config.face_min_score))
        .select(
            F.col("id").alias("photo_id"), F.col("box.x").alias("bbox_x"), F.col("box.y").alias("bbox_y"), F.col("box.w").alias("bbox_w"),
            F.col("box.h").alias("bbox_h"), F.col("f.score").alias("det_score"), F.col("f.vector").cast("array<float>").alias("embedding"),
            F.format_string("%d_%d.jpg", F.col("id"), F.col("k")).alias("crop_path"),
        )
    )
