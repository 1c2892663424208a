"""Keyed changes of a table, merged with its rows when it is read.

A change appends rows of new keys, puts whole rows, patches some columns of the rows with a key, or drops keys.  Changes are
folded by key first, so a table with any number of them is read with one aggregation over the changes and one join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("append", "put", "patch", "drop")


@dataclass(frozen=True)
class Change:
    """Rows of one kind of change; later changes of a table have greater numbers.

    append and put: whole rows, those of append with keys that the table doesn't hold.  patch: keys and the columns that it sets, also
    to null; keys that the table doesn't hold are passed over.  drop: keys.  No key comes twice in one change.
    """

    kind: str
    rows: DataFrame
    seq: int
    settled: bool = False

    def with_rows(self, rows: DataFrame) -> Change:
        return replace(self, rows=rows, settled=True)


def shaped(kind: str, rows: DataFrame, schema: T.StructType, key: Sequence[str]) -> DataFrame:
    """A change's rows with the table's types, in its columns' order."""
    if kind not in KINDS:
        raise ValueError(kind)
    names = {f.name for f in schema.fields} if kind in ("append", "put") else set(key) if kind == "drop" else set(rows.columns)
    missing = (names - set(rows.columns)) | (set(key) - names)
    unknown = names - {f.name for f in schema.fields}
    if missing or unknown:
        raise ValueError(f"{kind} of {sorted(rows.columns)}: missing {sorted(missing)}, unknown {sorted(unknown)}")
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields if f.name in names])


def merged(base: DataFrame, changes: Sequence[Change], schema: T.StructType, key: Sequence[str]) -> DataFrame:
    """The table after all changes.

    Columns that no patch sets are the base's own, so filters on them reach the scan.
    """
    appended = [c for c in changes if c.kind == "append"]
    keyed = [c for c in changes if c.kind != "append"]
    columns = [f.name for f in schema.fields]
    rows = base.select(*columns).withColumn("_from", F.lit(0))
    for c in appended:
        rows = rows.unionByName(c.rows.select(*columns).withColumn("_from", F.lit(c.seq)))
    if not keyed:
        return rows.drop("_from")
    rest = [n for n in columns if n not in key]
    patched = [n for n in rest if any(c.kind == "patch" and n in c.rows.columns for c in keyed)]
    alike, parts = {n: f"_p{i}" for i, n in enumerate(patched)}, []
    for c in keyed:
        seq = F.lit(c.seq)
        if c.kind == "patch":
            told = [F.struct(F.col(n).alias("v"), seq.alias("s")).alias(alike[n]) for n in patched if n in c.rows.columns]
        else:
            told = [seq.alias("_at"), F.lit(c.kind == "put").alias("_live")]
            if c.kind == "put":
                told.append(F.struct(*rest, F.lit(0).alias("_")).alias("_row"))
        parts.append(c.rows.select(*key, *told))
    folded = parts[0]
    for p in parts[1:]:
        folded = folded.unionByName(p, allowMissingColumns=True)
    puts, drops = any(c.kind == "put" for c in keyed), any(c.kind == "drop" for c in keyed)
    whole = [F.max("_at").alias("_at"), F.max_by("_live", "_at").alias("_live")] if puts or drops else []
    if puts:
        whole.append(F.max_by("_row", "_at").alias("_row"))
    folded = folded.groupBy(*key).agg(*whole, *[F.max_by(alike[n], f"{alike[n]}.s").alias(alike[n]) for n in patched])

    kept = rows.join(folded, list(key), "left")
    if whole:
        kept = kept.filter(F.coalesce("_at", F.lit(-1)) <= F.col("_from"))
    out = kept.select(*[F.when(F.col(f"{alike[n]}.s") > F.col("_from"), F.col(f"{alike[n]}.v")).otherwise(F.col(n)).alias(n) if n in patched else F.col(n) for n in columns])
    if puts:
        new = folded.filter("_live")
        later = {n: F.when(F.col(f"{alike[n]}.s") > F.col("_at"), F.col(f"{alike[n]}.v")).otherwise(F.col(f"_row.{n}")).alias(n) for n in patched}
        out = out.unionByName(new.select(*[F.col(n) if n in key else later.get(n, F.col(f"_row.{n}").alias(n)) for n in columns]))
    return out
