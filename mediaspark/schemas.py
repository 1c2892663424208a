"""The thirteen tables of a library and the snapshot that holds them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Types by name; a DDL parser would need a running session.
_TYPES = {
    "long": T.LongType(), "int": T.IntegerType(), "short": T.ShortType(), "double": T.DoubleType(), "string": T.StringType(),
    "boolean": T.BooleanType(), "timestamp_ntz": T.TimestampNTZType(), "array<float>": T.ArrayType(T.FloatType()),
}


def _table(columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(","))])


# Table and column names.
SCHEMAS: dict[str, T.StructType] = {
    "photos": _table(
        "id long, file_path string, file_hash string, file_size long, file_mtime timestamp_ntz, width int, height int, "
        "format string, orientation short, camera_make string, camera_model string, taken_at timestamp_ntz, "
        "gps_latitude double, gps_longitude double, ocr_text string, caption string, is_favorite boolean, "
        "faces_processed boolean, thumbnail_path string, phash long, duplicate_of long, created_at timestamp_ntz, "
        "updated_at timestamp_ntz"
    ),
    "faces": _table(
        "id long, photo_id long, bbox_x int, bbox_y int, bbox_w int, bbox_h int, det_score double, "
        "person_id long, embedding array<float>, crop_path string",
    ),
    "persons": _table(
        "id long, display_name string, face_count int, cover_face_id long, centroid array<float>, adaptive_threshold double",
    ),
    "person_embeddings": _table(
        "person_id long, face_id long, embedding array<float>, quality double, is_representative boolean"
    ),
    "recognition_feedback": _table("face_id long, person_id long, verdict string, created_at timestamp_ntz"),
    "recognition_suggestions": _table("face_id long, person_id long, score double"),
    "person_merge_suggestions": _table("person_a long, person_b long, score double"),
    "person_merge_rejections": _table("person_a long, person_b long"),
    "clip_embeddings": _table("photo_id long, embedding array<float>, model string, version int"),
    "albums": _table("id long, name string, cover_photo_id long, created_at timestamp_ntz, updated_at timestamp_ntz"),
    "album_photos": _table("album_id long, photo_id long, added_at timestamp_ntz"),
    "duplicate_dismissals": _table("group_key string"),
    "scan_runs": _table(
        "id long, root_path string, processed int, skipped int, duplicates int, errors int, "
        "started_at timestamp_ntz, finished_at timestamp_ntz"
    ),
}


# The columns that name a row of each table.
KEYS: dict[str, tuple[str, ...]] = {
    "photos": ("id",),
    "faces": ("id",),
    "persons": ("id",),
    "person_embeddings": ("face_id",),
    "recognition_feedback": ("face_id", "person_id"),
    "recognition_suggestions": ("face_id",),
    "person_merge_suggestions": ("person_a", "person_b"),
    "person_merge_rejections": ("person_a", "person_b"),
    "clip_embeddings": ("photo_id",),
    "albums": ("id",),
    "album_photos": ("album_id", "photo_id"),
    "duplicate_dismissals": ("group_key",),
    "scan_runs": ("id",),
}


@dataclass
class Part:
    """A table: base rows and their changes, the first `saved` of which lie on disk; `whole`: a save has to write all of it."""

    base: DataFrame | Callable[[], DataFrame]
    changes: tuple = ()
    saved: int = 0
    whole: bool = True
    content: DataFrame | None = None
    #: Of photos on disk: the trigram index and the base rows with their chunks; of clip vectors: cells, and the rows with theirs.
    index: tuple[DataFrame, DataFrame] | None = None

    def rows(self, name: str) -> DataFrame:
        if self.content is None:
            if not isinstance(self.base, DataFrame):
                self.base = self.base()
            if self.changes:
                from .sources.deltas import merged

                self.content = merged(self.base, self.changes, SCHEMAS[name], KEYS[name])
            else:
                self.content = self.base
        return self.content


class Library:
    """An immutable snapshot: one DataFrame a table, by attribute.  Mutations give a new Library.

    A table may be given as a function that makes it; it is called once, when something first asks for the table.  changed() keeps
    apart what a mutation changes, so that a save writes that alone; with_tables() replaces whole tables.  `source` is the (root,
    version) of the snapshot that the library came from, or None.
    """

    def __init__(self, tables: Mapping[str, DataFrame | Callable[[], DataFrame] | Part], source: tuple[str, int] | None = None):
        unknown = set(tables) - set(SCHEMAS)
        if unknown:
            raise KeyError(f"unknown tables: {sorted(unknown)}")
        self._parts = {n: t if isinstance(t, Part) else Part(t) for n, t in tables.items()}
        self.source = source

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self[name]
        except KeyError:
            raise AttributeError(name) from None

    def __getitem__(self, name: str) -> DataFrame:
        return self.__dict__["_parts"][name].rows(name)

    @property
    def tables(self) -> dict[str, DataFrame]:
        return {name: self[name] for name in self._parts}

    def part(self, name: str) -> Part | None:
        return self._parts.get(name)

    def with_tables(self, **changed: DataFrame | Part) -> Library:
        return Library(self._parts | changed, self.source)

    def changed(self, table: str, **rows: DataFrame) -> Library:
        """With changes of one table, in the order given: append, put, patch or drop, as sources.deltas.Change tells."""
        from .sources.deltas import Change, shaped

        part = self._parts[table]
        changes = part.changes
        for kind, df in rows.items():
            seq = changes[-1].seq + 1 if changes else 1
            changes = (*changes, Change(kind, shaped(kind, df, SCHEMAS[table], KEYS[table]), seq))
        # Until someone asks for the new rows, the base is made once for both.
        base = part.base if isinstance(part.base, DataFrame) else (lambda: _made(part))
        return self.with_tables(**{table: replace(part, base=base, changes=changes, content=None)})

    @classmethod
    def empty(cls, spark: SparkSession) -> Library:
        return cls({n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()})

    @classmethod
    def read(cls, spark: SparkSession, root: str) -> Library:
        """The snapshot that the pointer file of `root` names."""
        from .sources.snapshots import read_snapshot

        return read_snapshot(spark, root)


def _made(part: Part) -> DataFrame:
    if not isinstance(part.base, DataFrame):
        part.base = part.base()
    return part.base
