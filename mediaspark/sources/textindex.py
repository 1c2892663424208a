"""A trigram index of a snapshot's photos, so that a search for a rare text reads few pages of their files.

Photos lie in chunks of CHUNK rows in the order of their files.  The index has a row for each three bytes that a chunk's lower-case
text holds, sorted, so that Parquet's page statistics lead to the few pages of the trigrams asked for.  Chunks that hold
all trigrams of some token are candidates; their rows are read by page statistics too, and checked exactly afterwards.  Changes since
the photos were written whole are not indexed: their rows are always candidates.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SCHEMAS, Library

#: Rows of a chunk, as a power of two.
CHUNK_BITS = 4
#: Columns that each kind of search looks at; the kind's place is part of the index's key.
FIELDS = {"text": ("ocr_text",), "names": ("file_path", "camera_model")}
#: Rows of a page of photos and of the index; all columns' pages are as short, for page statistics to tell places apart.
PAGE, INDEX_PAGE = 64, 1_024
#: Candidate chunks that are worth a look-up; with more all rows are read.  Ranges of chunks that one scan is given.
CHUNKS, RANGES = 4_096, 32
#: Trigrams that one search asks for, and one token of it.
GRAMS, TOKEN_GRAMS = 60, 12


def with_chunks(photos: DataFrame) -> DataFrame:
    """Photos in the order of their files plus _chunk."""
    return photos.withColumn("_chunk", F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS))


def grams_of(photos: DataFrame) -> DataFrame:
    """(gram, chunk) of photos with their _chunk, sorted; gram holds three bytes and the field's place above them."""
    texts = [F.lower(F.concat_ws("\n", *columns)).cast("binary") for columns in FIELDS.values()]
    schema = pa.schema([("gram", pa.int32()), ("chunk", pa.int64())])

    def run(batches):
        for batch in batches:
            chunks = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], chunks[1:] != chunks[:-1]])) if len(chunks) else []
            grams, at = [], []
            for field in range(len(FIELDS)):
                column = batch.column(1 + field).to_pylist()
                for lo, hi in zip(starts, [*starts[1:], len(chunks)]):
                    b = np.frombuffer(b"\n".join(column[lo:hi]), np.uint8).astype(np.int32)
                    if len(b) > 2:
                        found = np.unique(b[:-2] | b[1:-1] << 8 | b[2:] << 16) | np.int32(field << 24)
                        grams.append(found)
                        at.append(np.full(len(found), chunks[lo]))
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams)), pa.array(np.concatenate(at))], schema=schema)

    rows = photos.select("_chunk", *texts).mapInArrow(run, "gram int, chunk long")
    return rows.repartitionByRange("gram", "chunk").sortWithinPartitions("gram", "chunk")


def write_indexed(spark: SparkSession, photos: DataFrame, path: str) -> None:
    """Write photos with their chunks, and beside them, in PATH.grams, the index."""
    # A dictionary would have to be read whole for one page.
    plain = {f"parquet.enable.dictionary#{c}": "false" for c in ("file_path", "file_hash", "thumbnail_path", "ocr_text", "caption")}
    with_chunks(photos).write.options(**plain).option("parquet.page.row.count.limit", PAGE).parquet(path)
    grams = grams_of(chunked(spark, path)).write.option("parquet.page.row.count.limit", INDEX_PAGE)
    grams.option("parquet.enable.dictionary", "false").option("compression", "zstd").parquet(f"{path}.grams")


def chunked(spark: SparkSession, path: str) -> DataFrame:
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SCHEMAS["photos"].fields)
    return spark.read.schema(f"{columns}, _chunk long").parquet(path)


def token_grams(spark: SparkSession, token: str, field: str) -> list[int]:
    """Keys of the trigrams that any text like %token% holds: none if its literal pieces are too short to tell."""
    place, out = list(FIELDS).index(field) << 24, []
    lowered = token.lower() if token.isascii() else spark.range(1).select(F.lower(F.lit(token))).first()[0]
    for piece in re.split(r"\\.|[%_\\]", lowered):
        b = piece.encode()
        out += [b[i] | b[i + 1] << 8 | b[i + 2] << 16 | place for i in range(len(b) - 2)]
    return list(dict.fromkeys(out))


def _candidates(grams: DataFrame, wanted: list[list[int]]) -> list[int] | None:
    """Numbers of the chunks that hold all grams of some token; None if there are too many to look up."""
    bits = {g: 1 << i for i, g in enumerate(dict.fromkeys(g for some in wanted for g in some))}
    asked = reduce(lambda a, b: a | b, [F.col("gram") == g for g in bits])
    bit = reduce(lambda c, g: c.when(F.col("gram") == g, F.lit(bits[g])), list(bits)[1:], F.when(F.col("gram") == next(iter(bits)), F.lit(1))).cast("long")
    held = grams.filter(asked).groupBy("chunk").agg(F.bit_or(bit).alias("held"))
    masks = [sum(bits[g] for g in some) for some in wanted]
    hit = reduce(lambda a, b: a | b, [F.col("held").bitwiseAND(F.lit(m).cast("long")) == m for m in masks])
    rows = held.filter(hit).select("chunk").limit(CHUNKS + 1).collect()
    return None if len(rows) > CHUNKS else sorted(r["chunk"] for r in rows)


def _ranges(chunks: Sequence[int]) -> Column:
    """A filter for at most RANGES ranges that cover the chunks, with the widest gaps between them."""
    if not chunks:
        return F.lit(False)
    gaps = sorted(range(1, len(chunks)), key=lambda i: chunks[i - 1] - chunks[i])[: RANGES - 1]
    cuts = [0, *sorted(gaps), len(chunks)]
    return reduce(lambda a, b: a | b, [F.col("_chunk").between(chunks[i], chunks[j - 1]) for i, j in zip(cuts, cuts[1:])])


def narrowed(lib: Library, tokens: Sequence[str], field: str = "text") -> Library:
    """The library with those photos that may hold a token (its % and _ are wildcards) in the field's columns, letter case aside.

    All photos where there is no index, or no token's trigrams tell anything, or too many chunks hold them.
    """
    part = lib.part("photos")
    if part is None or part.index is None or not tokens:
        return lib
    grams, base = part.index
    most = min(TOKEN_GRAMS, max(1, GRAMS // len(tokens)))
    wanted = [some[:: -(-len(some) // most)] for some in (token_grams(grams.sparkSession, t, field) for t in tokens) if some]
    if len(wanted) < len(tokens) or len(tokens) > GRAMS:
        return lib
    chunks = _candidates(grams, wanted)
    if chunks is None:
        return lib
    columns = [f.name for f in SCHEMAS["photos"].fields]
    near = _ranges(chunks)
    rows = base.filter(near).select(*columns)
    patched = [c.rows.select("id") for c in part.changes if c.kind == "patch" and set(FIELDS[field]) & set(c.rows.columns)]
    if patched:
        rest = base.filter(~near).join(reduce(DataFrame.union, patched).distinct(), "id", "left_semi")
        rows = rows.unionByName(rest.select(*columns))
    return lib.with_tables(photos=replace(part, base=rows, index=None, whole=True, saved=0, content=None))
