"""The import run: named steps in a fixed order over a library, each skipped where its backend is missing."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators import browse, mutations, recognition
from ..operators.graph import cut, settled
from ..schemas import Library
from ..sources import images


class Step(Protocol):
    name: str

    def available(self) -> bool: ...

    def run(self, lib: Library, content: Callable[[DataFrame], DataFrame]) -> tuple[Library, dict[str, int]]: ...


def _tally(rows: DataFrame) -> dict[str, int]:
    """Rows by status, in one pass."""
    r = rows.agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("status") != "ok").alias("errors")).first()
    return {"processed": r["processed"], "errors": r["errors"]}


@dataclass
class PhashStep:
    """Difference hashes of photos that have none; UNHASHABLE where a photo can't be read."""

    make: Callable[[], Callable[[bytes], int | None]] | None = None
    name: str = "phash"

    def available(self) -> bool:
        return self.make is not None

    def run(self, lib, content):
        rows = images.run_model(content(browse.pending_phash(lib)), self.make, "long")
        values = rows.select("id", F.coalesce("result", F.lit(images.UNHASHABLE)).alias("value"))
        return mutations.set_photo_values(lib, values, "phash"), _tally(rows)


@dataclass
class FaceStep:
    config: EngineConfig
    make: Callable | None = None
    name: str = "faces"

    def available(self) -> bool:
        return self.make is not None

    def run(self, lib, content):
        pending = browse.pending_faces(lib)
        sized = content(pending).join(lib.photos.select("id", "width", "height"), "id")
        faces = images.detect_faces(sized, self.make, self.config)
        out = mutations.replace_faces(lib, pending.select(F.col("id").alias("photo_id")), faces)
        return settled(out, "faces", "photos"), {"processed": pending.count(), "faces": faces.count()}


@dataclass
class PeopleStep:
    config: EngineConfig
    name: str = "people"

    def available(self) -> bool:
        return True

    def run(self, lib, content):
        return recognition.update_people(lib, self.config)


@dataclass
class ClipStep:
    config: EngineConfig
    make: Callable | None = None
    dim: int = 512
    name: str = "clip"

    def available(self) -> bool:
        return self.make is not None

    def run(self, lib, content):
        c = self.config
        pending = browse.pending_clip(lib, c.clip_model, c.clip_version)
        rows = images.embed_images(content(pending), self.make, c.clip_model, c.clip_version, self.dim)
        done = rows.count()
        return mutations.upsert_clip(lib, rows), {"processed": done, "errors": pending.count() - done}


@dataclass
class OcrStep:
    make: Callable | None = None
    name: str = "ocr"

    def available(self) -> bool:
        return self.make is not None

    def run(self, lib, content):
        values = images.recognise_texts(content(browse.pending_ocr(lib)), self.make)
        r = values.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") != "").alias("t")).first()
        return mutations.set_photo_values(lib, values, "ocr_text"), {"processed": r["n"], "with_text": r["t"]}


@dataclass
class ThumbnailStep:
    """make() gives a function that writes a thumbnail of some content and returns its path."""

    make: Callable | None = None
    name: str = "thumbnails"

    def available(self) -> bool:
        return self.make is not None

    def run(self, lib, content):
        rows = images.run_model(content(browse.pending_thumbnails(lib)), self.make, "string")
        values = rows.filter("status = 'ok'").select("id", F.col("result").alias("value"))
        return mutations.set_photo_values(lib, values, "thumbnail_path"), _tally(rows)


def make_thumbnails(lib: Library, root: str, folder: str, size: int = 320, limit: int | None = None) -> tuple[Library, dict[str, int]]:
    """Thumbnails of photos below `root` that have none, written to a folder that all tasks share: the library and a report.

    A photo that can't be decoded keeps none and is counted.
    """
    pending = browse.pending_thumbnails(lib) if limit is None else browse.pending_thumbnails(lib).orderBy("id").limit(limit)
    photos = pending.select("id", "file_path").join(lib.photos.select("id", "orientation"), "id")
    rows = cut(images.write_images(images.thumbnails(photos, root, size), folder, "id"))
    r = rows.agg(F.count("path").alias("generated"), F.count_if(F.col("path").isNull()).alias("errors")).first()
    values = rows.filter("path is not null").select("id", F.col("path").alias("value"))
    return mutations.set_photo_values(lib, values, "thumbnail_path"), {"generated": r["generated"], "errors": r["errors"]}


def default_steps(config: EngineConfig, thumbnail=None, phash=None, faces=None, clip=None, ocr=None, dim: int = 512) -> list[Step]:
    """thumbnails, phash, faces, people, clip, ocr: in this order."""
    return [
        ThumbnailStep(thumbnail), PhashStep(phash), FaceStep(config, faces), PeopleStep(config), ClipStep(config, clip, dim), OcrStep(ocr),
    ]


@dataclass
class ImportRun:
    """Runs steps one after another and keeps what each reported."""

    steps: Sequence[Step]
    reports: dict[str, dict[str, int]] = field(default_factory=dict)

    def run(
        self,
        lib: Library,
        content: Callable[[DataFrame], DataFrame],
        on_step: Callable[[str], None] | None = None,
    ) -> Library:
        """`content` adds content to photos (id, file_path); on_step may raise to stop between steps."""
        for step in self.steps:
            if not step.available():
                continue
            if on_step:
                on_step(step.name)
            lib, self.reports[step.name] = step.run(lib, content)
        return lib


def file_content(spark, root: str) -> Callable[[DataFrame], DataFrame]:
    """content() for photos whose files lie below a folder."""
    files = images.image_files(spark, root).select(F.col("path").alias("file_path"), "content")
    return lambda photos: photos.join(files, "file_path")


def pending(lib: Library, config: EngineConfig, now: datetime | None = None) -> DataFrame:
    return browse.pending_counts(lib, config.clip_model, config.clip_version)
