"""Pairs of 64-bit values within a few differing bits, by keys that grow longer where many values share them.

Values that differ in at most d bits agree in one of d + 1 parts of the bits, so each value stands in d + 1 lists.  A list of more than
CELL values is refined: of d + 1 parts of the remaining bits one agrees again, and so on for LEVELS levels.  Low-entropy values
thus get long keys and others keep short ones.  Lists that are still long are compared in cells of CELL values a side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import to_signed
from .graph import cut

#: Values of a list that are compared at once, and levels of parts.
CELL, LEVELS = 2_048, 3


class Parts:
    """The parts of all levels by code: a first part has its number, part j under code c is (c + 1) * n + j."""

    def __init__(self, distance: int):
        self.n = distance + 1
        self.masks: list[int] = []  # all bits of the key
        self.earlier: list[list[int]] = []  # parts before it and before those above it
        above: list[tuple[list[int], int, list[int]]] = [(list(range(64)), 0, [])]
        for _ in range(LEVELS):
            below = []
            for bits, mask, earlier in above:
                own = [sum(1 << int(b) for b in part) for part in np.array_split(bits, self.n)]
                for j, m in enumerate(own):
                    # A part without bits agrees always; those after it need not be looked at.
                    self.masks.append(mask | m)
                    self.earlier.append(earlier + own[:j])
                    below.append(([b for b in bits if not m >> b & 1], mask | m, earlier + own[:j]))
            above = below

    def first(self, code: int, x: np.ndarray) -> np.ndarray:
        """Whether the differences x of values in a list of this code agree in no earlier part."""
        ok = np.ones(len(x), bool)
        for m in self.earlier[code]:
            ok &= (x & np.uint64(m)) != 0
        return ok


def _lists(hashes: DataFrame, parts: Parts) -> DataFrame:
    key = F.explode(F.array(*[F.struct(F.lit(i).alias("code"), _masked(F.lit(to_signed(parts.masks[i]))).alias("v")) for i in range(parts.n)]))
    return hashes.select("phash", key.alias("key")).select("key.code", "key.v", "phash")


def _masked(mask):
    return F.col("phash").bitwiseAND(mask.cast("long"))


def _refined(rows: DataFrame, parts: Parts) -> DataFrame:
    """Rows (code, v, phash) under the parts of the next level."""
    masks = F.array(*[F.lit(to_signed(m)).cast("long") for m in parts.masks])
    below = F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts.n - 1)), lambda j: (F.col("code") + 1) * parts.n + j))
    return rows.select("phash", below.alias("code")).select("code", _masked(F.element_at(masks, F.col("code") + 1)).alias("v"), "phash")


def _long(rows: DataFrame, cell: int) -> DataFrame:
    sizes = rows.groupBy("code", "v").agg(F.count(F.lit(1)).alias("size"))
    return cut(sizes.filter(F.col("size") > cell))


def hamming_join(hashes: DataFrame, distance: int, spanning: bool = False, cell: int = CELL) -> DataFrame:
    """(a, b, distance) with a < b of distinct values (phash) that differ in at most `distance` bits, each pair once.

    With `spanning` only pairs come that join what the pairs before them in the same lists have not joined: the same connected
    components, and no square of a family.  Null values are left out.
    """
    parts = Parts(distance)
    values = cut(hashes.select("phash").filter("phash is not null").distinct())
    rows, short = _lists(values, parts), []
    for level in range(LEVELS):
        long = _long(rows, cell)
        if long.isEmpty():
            short.append(rows)
            rows = None
            break
        short.append(rows.join(long.select("code", "v"), ["code", "v"], "left_anti"))
        crowded = rows.join(long, ["code", "v"])
        if level == LEVELS - 1:
            rows = crowded
        else:
            rows = cut(_refined(crowded, parts))
    plain = [F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(0).alias("block")]
    dealt = short[0]
    for s in short[1:]:
        dealt = dealt.unionByName(s)
    dealt = dealt.select("code", "v", *plain, "phash")
    if rows is not None:
        blocks = F.ceil(F.col("size") / F.lit(max(1, cell // 2))).cast("int")
        block = F.pmod(F.xxhash64("phash"), blocks).cast("int")
        rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        dealt = dealt.unionByName(
            rows.select("code", "v", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "phash")
        )
    keys = ["code", "v", "low", "high"]
    # Values of a list in the order of their bits, so that a family's neighbours meet first.
    ordered = dealt.repartition(*keys).sortWithinPartitions(*keys, "phash")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("distance", pa.int32())])

    def run(batches):
        for code, lists, low, high, block, x in _whole(batches, 2 * cell):
            for c in np.unique(code):
                at = code == c
                for a, b, d in _pairs(lists[at], low[at] == high[at], block[at], x[at], int(c), parts, distance, spanning):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d.astype(np.int32))], schema=schema)

    return ordered.mapInArrow(run, "a long, b long, distance int")


def _whole(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[np.ndarray]]:
    """code, list number, low, high, block and value of sorted rows, cut between lists only; no list is longer than about `most`."""
    kept: list[list[np.ndarray]] = []

    def numbered():
        code, v, low, high, block, x = (np.concatenate(c) for c in zip(*kept))
        new = (code[1:] != code[:-1]) | (v[1:] != v[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        return [code, np.concatenate([[0], np.cumsum(new)]), low, high, block, x], [code, v, low, high, block, x]

    size = 0
    for batch in batches:
        kept.append([c.to_numpy() for c in batch.columns])
        size += batch.num_rows
        if size >= 8 * most:
            columns, raw = numbered()
            done = int(np.searchsorted(columns[1], columns[1][-1]))
            if done:
                yield [c[:done] for c in columns]
            kept = [[c[done:] for c in raw]]
            size -= done
    if size:
        yield numbered()[0]


def _pairs(lists, alone, block, x, code: int, parts: Parts, distance: int, spanning: bool):
    """Near pairs of each list, members at distance 1, 2, ... in the list, all lists of a code at once."""
    label = np.arange(len(x))
    i, lag = np.flatnonzero(lists[1:] == lists[:-1]), 1
    while len(i):
        j = i + lag
        pick = (alone[i] | (block[i] != block[j])) & ((label[i] != label[j]) if spanning else True)
        p, q = i[pick], j[pick]
        diff = (x[p] ^ x[q]).view(np.uint64)
        d = np.bitwise_count(diff)
        near = d <= distance
        if not spanning:
            near[near] = parts.first(code, diff[near])
        if near.any():
            p, q, d = p[near], q[near], d[near]
            if spanning:
                new = _joined(label, p, q)
                p, q, d = p[new], q[new], d[new]
            yield x[p], x[q], d
        lag += 1
        i = i[i + lag < len(lists)]
        i = i[lists[i] == lists[i + lag]]


def _joined(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> list[int]:
    """Join the labels of pairs; which of them joined two."""
    up: dict[int, int] = {}

    def root(k: int) -> int:
        while k in up:
            k = up[k]
        return k

    new = []
    for n, (a, b) in enumerate(zip(label[p].tolist(), label[q].tolist())):
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
            new.append(n)
    old = np.array(sorted(up))
    to = np.array([root(k) for k in old.tolist()])
    at = np.minimum(np.searchsorted(old, label), len(old) - 1)
    hit = old[at] == label
    label[hit] = to[at[hit]]
    return new
