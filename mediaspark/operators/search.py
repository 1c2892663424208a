"""Vector search and hybrid ranking."""

from __future__ import annotations

import hashlib
import json
import os
from collections import OrderedDict
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.vectors import cosine, literal
from ..schemas import Library
from ..sources.vectorindex import narrowed
from .browse import TOKEN_LENGTH, person_by_name, photo_filters


def nearest(
    lib: Library,
    query: Sequence[float] | Column,
    model: str,
    limit: int,
    favorite: bool | None = None,
    since: datetime | None = None,
    until: datetime | None = None,
    person_id: int | None = None,
) -> DataFrame:
    """photo_id and similarity (-1 to 1) of the photos nearest to a vector by cosine, of one model, under filters.

    Exact: one scan of the model's vectors with a top-k in each task.  Filters are applied before the top-k, so
    they never leave fewer results than there are.  A vector without length is never found.  Of a snapshot's vectors
    only the cells are scanned that may hold one of the nearest.
    """
    filters = (favorite, since, until, person_id)
    if not isinstance(query, Column):
        lib = narrowed(lib, query, model, limit, lambda few: _scanned(few, query, model, limit, *filters))
    return _scanned(lib, query, model, limit, *filters)


def _scanned(
    lib: Library,
    query: Sequence[float] | Column,
    model: str,
    limit: int,
    favorite: bool | None,
    since: datetime | None,
    until: datetime | None,
    person_id: int | None,
) -> DataFrame:
    vector = query if isinstance(query, Column) else literal(query)
    rows = lib.clip_embeddings.filter(F.col("model") == model).select("photo_id", cosine(F.col("embedding"), vector).alias("similarity"))
    if any(x is not None for x in (favorite, since, until, person_id)):
        allowed = photo_filters(lib, favorite, since, until, person_id).select(F.col("id").alias("photo_id"))
        rows = rows.join(allowed, "photo_id", "left_semi")
    return rows.filter(F.col("similarity").isNotNull()).orderBy(F.desc("similarity"), "photo_id").limit(limit)


def similar_photos(lib: Library, photo_id: int, limit: int = 20) -> DataFrame:
    """Photos nearest to one photo among vectors of its model, itself left out; none if it has no vector."""
    own = lib.clip_embeddings.filter(F.col("photo_id") == photo_id).select(
        F.col("embedding").alias("own"), F.col("model").alias("own_model")
    )
    rows = lib.clip_embeddings.join(F.broadcast(own.limit(1)), F.col("model") == F.col("own_model"))
    near = (
        rows.filter(F.col("photo_id") != photo_id)
        .select("photo_id", cosine(F.col("embedding"), F.col("own")).alias("similarity"))
        .filter(F.col("similarity").isNotNull())
        .orderBy(F.desc("similarity"), "photo_id")
        .limit(limit)
    )
    photos = lib.photos.select(F.col("id").alias("photo_id"), "file_path", "thumbnail_path")
    return photos.join(F.broadcast(near), "photo_id").select("photo_id", "file_path", "thumbnail_path", "similarity")


def rank(candidates: DataFrame, config: EngineConfig, limit: int) -> DataFrame:
    """The best candidates by similarity plus boosts for matched text, favourites and recency.

    Recency runs from 0 for the oldest candidate to 1 for the newest; undated ones get 0.  Equal scores keep the
    vector order, then the text order.  The candidates are a pool of bounded size, so one window holds them.
    """
    everything = Window.partitionBy()
    at = F.unix_micros(F.col("taken_at").cast("timestamp"))
    low, high = F.min(at).over(everything), F.max(at).over(everything)
    recency = F.coalesce((at - low) / F.when(high > low, high - low).otherwise(F.lit(1)), F.lit(0.0))
    score = (
        F.col("similarity")
        + F.when(F.col("ocr_hit"), config.search_ocr_boost).otherwise(0.0)
        + F.when(F.col("is_favorite"), config.search_favorite_boost).otherwise(0.0)
        + config.search_recency_boost * recency
    )
    return (
        candidates.withColumn("score", score)
        .orderBy(F.desc("score"), F.desc("in_clip"), F.desc("similarity"), F.col("taken_at").desc_nulls_last(), F.desc("photo_id"))
        .limit(limit)
    )


def search(
    lib: Library,
    query: str,
    encode: Callable[[str], Sequence[float]],
    config: EngineConfig = EngineConfig(),
    limit: int = 100,
    favorite: bool | None = None,
    since: datetime | None = None,
    until: datetime | None = None,
    person_id: int | None = None,
) -> DataFrame:
    """Hybrid search: photos near the query's vector, and photos whose text holds a query word, ranked together.

    A blank query finds nothing.  The first word that names exactly one person restricts the search to that
    person, unless one is given.  Both candidate lists take the best max(4 * limit, 200).
    """
    text = query.strip()
    pool = max(4 * limit, 200)
    if not text:
        return _candidates(lib, lib.clip_embeddings.limit(0).select("photo_id", F.lit(0.0).alias("similarity")), [], 0).limit(0).withColumn(
            "score", F.lit(0.0)
        )
    if person_id is None:
        for word in text.split():
            row = person_by_name(lib, word).first()
            if row:
                person_id = row["id"]
                break
    near = nearest(lib, encode(text), config.clip_model, pool, favorite, since, until, person_id)
    return rank(_candidates(lib, near, text.split(), pool, favorite, since, until, person_id), config, limit)


def _candidates(lib: Library, near: DataFrame, words: Sequence[str], pool: int, *filters) -> DataFrame:
    """Full outer union of both candidate lists by photo."""
    tokens = [w for w in words if len(w) >= TOKEN_LENGTH]
    hit = F.lit(False)
    for t in tokens:
        hit = hit | F.col("ocr_text").ilike(f"%{t}%")
    texts = (
        photo_filters(lib, *filters)
        .filter(hit)
        .orderBy(F.col("taken_at").desc_nulls_last(), F.desc("id"))
        .limit(pool)
        .select(F.col("id").alias("photo_id"), F.lit(True).alias("ocr_hit"))
    )
    both = near.withColumn("in_clip", F.lit(1)).join(texts, "photo_id", "full_outer")
    photos = lib.photos.select(F.col("id").alias("photo_id"), "file_path", "thumbnail_path", "taken_at", "is_favorite")
    # Two pools at most.
    return photos.join(F.broadcast(both), "photo_id").select(
        "photo_id",
        "file_path",
        "thumbnail_path",
        "taken_at",
        "is_favorite",
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
        F.coalesce("ocr_hit", F.lit(False)).alias("ocr_hit"),
        F.coalesce("in_clip", F.lit(0)).alias("in_clip"),
    )


class TextVectorCache:
    """Query vectors by model, version and trimmed lower-case text; the least recently used one goes first.

    With `folder` each vector is also kept in a file there, which a later process finds again; a file that can't be read
    or written counts as missing.
    """

    def __init__(
        self, encode: Callable[[str], Sequence[float]], model: str, version: int, capacity: int = 256, folder: str | None = None
    ):
        self.encode, self.model, self.version, self.capacity, self.folder = encode, model, version, capacity, folder
        self.entries: OrderedDict[str, tuple[float, ...]] = OrderedDict()

    def key(self, text: str) -> str:
        return f"{self.model}|{self.version}|{text.strip().lower()}"

    def _file(self, key: str) -> str:
        return os.path.join(self.folder, f"{hashlib.sha256(key.encode()).hexdigest()}.json")

    def _kept(self, key: str) -> tuple[float, ...] | None:
        if self.folder is None:
            return None
        try:
            with open(self._file(key)) as f:
                return tuple(float(x) for x in json.load(f))
        except (OSError, ValueError, TypeError):
            return None

    def _keep(self, key: str, vector: tuple[float, ...]) -> None:
        if self.folder is None:
            return
        try:
            os.makedirs(self.folder, exist_ok=True)
            with open(self._file(key) + ".new", "w") as f:
                json.dump(vector, f)
            os.replace(f.name, self._file(key))
        except OSError:
            pass  # the cache only saves time

    def __call__(self, text: str) -> tuple[float, ...]:
        key = self.key(text)
        if key not in self.entries:
            vector = self._kept(key)
            if vector is None:
                vector = tuple(float(x) for x in self.encode(text))
                self._keep(key, vector)
            self.entries[key] = vector
        self.entries.move_to_end(key)
        while len(self.entries) > self.capacity:
            self.entries.popitem(last=False)
        return self.entries[key]
