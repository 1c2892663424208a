"""SimHash near duplicates by the generalised pigeonhole principle.

The bits of the fingerprints are put into m parts.  If thresholds t1..tm, each -1 or more, add up to limit - m + 1, two
fingerprints within `limit` bits are within ti bits in some part i; a part of threshold -1 is not looked at.  So each fingerprint
may choose thresholds of its own: it probes the values of part i within ti bits of its own, and every fingerprint is indexed by its
value in every part.

* Correlated bits go into one part, so that the crowding that they cause stays in few parts.  Correlations are those of all fingerprints.
* Thresholds come from dynamic programming over the parts, on the number of candidates that each threshold gives, estimated from
  the counts of all fingerprints in subparts of at most 16 bits, and on the rows that it sends.
* The number of parts is the one whose estimated costs over all fingerprints are least.

Equal fingerprints are one class.  A list of a (part, value) gives a spanning forest of the links among its members, never
all pairs.  A list of more than `cell` members is refined: four differing bits at most leave one of five groups of its other bits untouched, so its members
are listed anew under each group's value.  What is still longer is compared in cells of `cell` members a side: the diagonal first, and then, once
all links found are joined to components, the other cells of lists that still hold several components, but only across components.
So connectivity is exact: a pair is left out only if its two fingerprints are known to be connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, arrow_schema, in_arrow, map_rows, parts_of, root_of, spread_join, staged, texts_of, utf8
from .components import connected_components

BITS = 64
#: Numbers of parts to choose from.
PARTS = (2, 3, 4, 5, 6)
#: Members of a list that are compared at once.
CELL = 2048
#: Costs of comparing two fingerprints, in rows sent.
COMPARE = 0.01
#: Numbers of fingerprints whose bits are taken apart at once.
CHUNK = 1 << 14


class SimHasher:
    """The fingerprint of a text: bit i is 1 if it is set in over half of the XXH64 (seed 42) of its `width`-word shingles."""

    def __init__(self, width: int):
        self.width = width
        self.memory = Memo(lambda shingle: xxhash.xxh64_intdigest(shingle, 42), 16 << 20)

    def __call__(self, text: bytes) -> int:
        words = text.lower().split()  # bytes: A-Z only, and the six blanks
        k = self.width
        if len(words) <= k:
            return xxhash.xxh64_intdigest(b" ".join(words), 42) if words else 0
        counts, n = np.zeros(BITS, np.int64), len(words) - k + 1
        for lo in range(0, n, CHUNK):
            some = words[lo : lo + CHUNK + k - 1]
            h = np.array([xxhash.xxh64_intdigest(s, 42) for s in map(b" ".join, zip(*[some[i:] for i in range(k)]))], "<u8")
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        bits = np.packbits(2 * counts > n, bitorder="little")
        return int.from_bytes(bits.tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for each row: the 64-bit fingerprint as a long; without words it is zero."""

    def make():
        of = SimHasher(width)

        def run(row):
            fp = of(row[1])
            return row[0], fp - (1 << 64) if fp >> 63 else fp

        return run

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col), utf8(text_col)), make, f"doc_id {kind}, fp long")


def bits_of(fps: np.ndarray) -> np.ndarray:
    """One row of 64 zeros and ones for each fingerprint, bit 0 first."""
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_correlations(classes: DataFrame, fp_col: str = "fp") -> np.ndarray:
    """The correlation of each two of the 64 bits over all rows; 0 where a bit never changes.

    A task hands on 4,096 sums, which Spark adds up; the driver sees 4,096 rows.
    """
    ddl = "i int, j int, n long"
    schema = arrow_schema(ddl)

    def run(batches):
        total = np.zeros((BITS, BITS), np.int64)
        for batch in parts_of(batches):
            x = bits_of(batch.column(0).to_numpy()).astype(np.float32)
            total += (x.T @ x).astype(np.int64)
        i, j = np.divmod(np.arange(BITS * BITS, dtype=np.int32), BITS)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.reshape(-1))], schema=schema)

    rows = in_arrow(classes.select(fp_col), run, ddl).groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((BITS, BITS))
    for r in rows:
        both[r["i"], r["j"]] = r["n"]
    n = max(1, classes.count())
    p = np.diag(both) / n
    spread = np.sqrt(p * (1 - p))
    with np.errstate(divide="ignore", invalid="ignore"):
        out = (both / n - np.outer(p, p)) / np.outer(spread, spread)
    return np.nan_to_num(out, nan=0.0, posinf=0.0, neginf=0.0)


def grouped_bits(correlations: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in `parts` parts of near-equal size, correlated ones together.

    A part begins with the two remaining bits of the strongest correlation and takes the bit with the largest sum of
    correlations with its own until it is full.
    """
    strength = np.abs(correlations) - np.eye(BITS) * 2
    left, out = list(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        among = strength[np.ix_(left, left)]
        i, j = divmod(int(among.argmax()), len(left))
        part = [left[i], left[j]]
        while len(part) < size:
            rest = [b for b in left if b not in part]
            part.append(rest[int(strength[np.ix_(part, rest)].sum(axis=0).argmax())])
        left = [b for b in left if b not in part]
        out.append(part)
    return out


def values_of(bits: np.ndarray, part: list[int]) -> np.ndarray:
    """The number that each row's bits of a part form."""
    return bits[:, part].astype(np.int64) @ (np.int64(1) << np.arange(len(part), dtype=np.int64))


class Plan:
    """Parts, their subparts and the counts of all fingerprints within 0 to `limit` bits of each value of a subpart."""

    def __init__(self, parts: list[list[int]], limit: int):
        self.parts, self.limit = parts, limit
        self.subparts = [np.array_split(np.array(p), -(-len(p) // 16)) for p in parts]
        self.masks = [[_masks(len(p), t) for t in range(limit + 1)] for p in parts]
        self.near: list[list[np.ndarray]] = []
        self.n = 0

    def count(self, histograms: dict[tuple[int, int], np.ndarray], n: int) -> None:
        self.n = max(1, n)
        self.near = [
            [(_spheres(histograms[i, s], len(sub), self.limit) / self.n).astype(np.float32) for s, sub in enumerate(subs)]
            for i, subs in enumerate(self.subparts)
        ]

    def costs(self, bits: np.ndarray) -> np.ndarray:
        """The cost of each threshold -1..top of each part for each row, [row, part, threshold + 1]; infinite over the part's top."""
        top = self.top()
        out = np.full((len(bits), len(self.parts), top + 2), np.inf)
        for i, subs in enumerate(self.subparts):
            share = None
            for s, sub in enumerate(subs):
                one = self.near[i][s][: top + 1, values_of(bits, list(sub))].T
                if share is None:
                    share = one
                else:  # subparts count as independent
                    share = np.stack([sum(share[:, a] * one[:, t - a] for a in range(t + 1)) for t in range(top + 1)], axis=1)
            candidates = self.n * np.cumsum(share, axis=1)
            out[:, i, 0] = 0
            for t in range(top + 1):
                out[:, i, t + 1] = len(self.masks[i][t]) - 1 + COMPARE * candidates[:, t]
        return out

    def top(self) -> int:
        """The largest threshold that a part can have: all others -1."""
        return self.limit

    def thresholds(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The thresholds of least cost for each row, and that cost: dynamic programming over parts and sums."""
        costs = self.costs(bits)
        n, m, k = costs.shape
        want = self.limit - m + 1 + m  # each threshold counts from -1
        best = np.full((n, want + 1), np.inf)
        best[:, 0] = 0
        took = np.zeros((n, m, want + 1), np.int8)
        for i in range(m):
            new = np.full_like(best, np.inf)
            for t in range(min(k, want + 1)):
                cost = best[:, : want + 1 - t] + costs[:, i, t][:, None]
                better = cost < new[:, t:]
                new[:, t:][better] = cost[better]
                took[:, i, t:][better] = t
            best = new
        out, at = np.zeros((n, m), np.int64), np.full(n, want)
        for i in range(m - 1, -1, -1):
            out[:, i] = took[np.arange(n), i, at]
            at = at - out[:, i]
        return out - 1, best[:, want]


def _masks(width: int, t: int) -> np.ndarray:
    """All numbers of `width` bits with at most t ones, 0 first."""
    from itertools import combinations

    return np.array([sum(1 << b for b in c) for k in range(t + 1) for c in combinations(range(width), k)], np.int64)


def _spheres(histogram: np.ndarray, width: int, limit: int) -> np.ndarray:
    """For each value the number of rows at exactly 0 to `limit` bits from it, [distance, value], adding one bit after the other."""
    out = np.zeros((limit + 1, len(histogram)))
    out[0] = histogram
    at = np.arange(len(histogram))
    for b in range(width):
        flipped = out[:, at ^ (1 << b)]
        out[1:] += flipped[:-1]
    return out


def plan_for(classes: DataFrame, limit: int, fp_col: str = "fp") -> Plan:
    """The plan of least estimated cost for the rows of `classes`, one for each distinct fingerprint."""
    correlations = bit_correlations(classes, fp_col)
    plans = [Plan(grouped_bits(correlations, m), limit) for m in PARTS if m <= limit + 2]
    fps = classes.select(fp_col)
    n = classes.count()
    wanted = [(k, i, s, list(map(int, sub))) for k, p in enumerate(plans) for i, subs in enumerate(p.subparts) for s, sub in enumerate(subs)]
    ddl = "k int, v int, n long"
    schema = arrow_schema(ddl)

    def counted(batches):
        # At most 65,536 counts for each subpart.
        totals = [np.zeros(1 << len(sub), np.int64) for *_, sub in wanted]
        for batch in parts_of(batches):
            bits = bits_of(batch.column(0).to_numpy())
            for total, (*_, sub) in zip(totals, wanted):
                np.add.at(total, values_of(bits, sub), 1)
        for k, total in enumerate(totals):
            v = np.flatnonzero(total)
            if len(v):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(v.astype(np.int32)), pa.array(total[v])], schema=schema)

    sums = in_arrow(fps, counted, ddl).groupBy("k", "v").agg(F.sum("n").alias("n"))
    found = [np.zeros(1 << len(sub), np.int64) for *_, sub in wanted]
    for r in sums.toLocalIterator():
        found[r["k"]][r["v"]] = r["n"]
    for k, p in enumerate(plans):
        p.count({(i, s): h for (q, i, s, _), h in zip(wanted, found) if q == k}, n)
    if len(plans) == 1 or not n:
        return plans[-1]

    ddl = "k int, cost double"
    priced_schema = arrow_schema(ddl)

    def priced(batches):
        total = np.zeros(len(plans))
        for batch in parts_of(batches):
            bits = bits_of(batch.column(0).to_numpy())
            total += [(p.thresholds(bits)[1] + len(p.parts)).sum() for p in plans]
        out = [pa.array(np.arange(len(plans), dtype=np.int32)), pa.array(total)]
        yield pa.RecordBatch.from_arrays(out, schema=priced_schema)

    prices = in_arrow(fps, priced, ddl).groupBy("k").agg(F.sum("cost").alias("cost")).collect()
    return plans[min(prices, key=lambda r: (r["cost"], r["k"]))["k"]]


def probes(classes: DataFrame, plan: Plan, fp_col: str = "fp") -> DataFrame:
    """(list, fp): each fingerprint under its own value of each part, and under the values that its thresholds probe."""
    ddl = "list long, fp long"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in parts_of(batches):
            fps = batch.column(0).to_numpy()
            bits = bits_of(fps)
            thresholds, _ = plan.thresholds(bits)
            for i, part in enumerate(plan.parts):
                values = values_of(bits, part)
                for t in range(plan.limit + 1):
                    chosen = thresholds[:, i] == t if t else thresholds[:, i] <= 0
                    masks = plan.masks[i][t]
                    for lo in range(0, len(fps), max(1, (1 << 18) // len(masks))):
                        some = slice(lo, lo + max(1, (1 << 18) // len(masks)))
                        of = np.repeat(fps[some][chosen[some]], len(masks))
                        at = (values[some][chosen[some]][:, None] ^ masks[None, :]).reshape(-1)
                        if len(of):
                            lists = at | np.int64(i << 32)
                            yield pa.RecordBatch.from_arrays([pa.array(lists), pa.array(of)], schema=schema)

    return in_arrow(classes.select(fp_col), run, ddl)


def _forest(lists: np.ndarray, fps: np.ndarray, limit: int, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that span the components of each list; lists are sorted, label holds a number of what is known as connected.

    Members are compared at distance 1, 2, ... in their list, all lists at once; `label` is kept up to date, so a link within
    what is already joined is not given.
    """
    a = np.flatnonzero(lists[1:] == lists[:-1])
    lag = 1
    while len(a):
        linked = a[label[a] != label[a + lag]]
        linked = linked[np.bitwise_count((fps[linked] ^ fps[linked + lag]).view(np.uint64)) <= limit]
        if len(linked):
            yield _joined(label, linked, linked + lag)
        lag += 1
        a = a[a + lag < len(lists)]
        a = a[lists[a] == lists[a + lag]]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join the labels of the pairs (a, b); gives the pairs that joined two."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    new = []
    for k, (x, y) in enumerate(zip(label[a].tolist(), label[b].tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            new.append(k)
    old = np.array(sorted(parent), label.dtype)
    roots = np.array([root(x) for x in old.tolist()], label.dtype)
    at = np.minimum(np.searchsorted(old, label), len(old) - 1)
    hit = old[at] == label
    label[hit] = roots[at[hit]]
    return a[new], b[new]


def _whole_lists(batches: Iterator[pa.RecordBatch], columns: int, most: int) -> Iterator[list[np.ndarray]]:
    """The columns of sorted rows, cut between lists only; a list has at most `most` rows by its making."""
    kept: list[list[np.ndarray]] = [[] for _ in range(columns)]
    size = 0

    def taken():
        return [np.concatenate(c) for c in kept]

    for batch in batches:
        for lo in range(0, batch.num_rows, 16 * most):
            part = batch.slice(lo, 16 * most)
            for c, column in zip(kept, part.columns):
                c.append(column.to_numpy())
            size += part.num_rows
            if size >= 16 * most:
                whole = taken()
                cut = int(np.searchsorted(whole[0], whole[0][-1]))
                if cut:
                    yield [c[:cut] for c in whole]
                kept = [[c[cut:]] for c in whole]
                size = len(whole[0]) - cut
    if size:
        yield taken()


def links_in_lists(rows: DataFrame, limit: int, most: int) -> DataFrame:
    """(a, b): a spanning forest of the links within each list of `rows` (list long, fp long), none longer than `most`."""
    schema = arrow_schema("a long, b long")

    def run(batches):
        for lists, fps in _whole_lists(batches, 2, most):
            label = np.arange(len(fps))
            for a, b in _forest(lists, fps, limit, label):
                yield pa.RecordBatch.from_arrays([pa.array(fps[a]), pa.array(fps[b])], schema=schema)

    dealt = rows.select("list", "fp").repartition("list").sortWithinPartitions("list", "fp")
    return in_arrow(dealt, run, "a long, b long")


def refined(rows: DataFrame, plan: Plan, limit: int) -> DataFrame:
    """(list, fp): the members of long lists under the values of limit + 1 groups of the bits outside the list's part."""
    ddl = "list long, fp long"
    schema = arrow_schema(ddl)
    outside = [np.array_split(np.array([b for p in plan.parts if p is not part for b in p]), limit + 1) for part in plan.parts]

    def run(batches):
        for batch in parts_of(batches):
            lists, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            bits = bits_of(fps)
            for i, groups in enumerate(outside):
                own = np.flatnonzero(lists >> 32 == i)
                for j, group in enumerate(groups if len(own) else []):
                    # The old list, the group and its value, mixed to one long: two lists that meet by chance only grow.
                    key = lists[own] * np.int64(-7046029254386353131) + values_of(bits[own], list(group))
                    key = (key ^ (key >> 29)) * np.int64(-4417276706812531889) + np.int64(j)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[own])], schema=schema)

    return in_arrow(rows.select("list", "fp"), run, ddl)


def _long_lists(rows: DataFrame, most: int) -> DataFrame:
    """(list, blocks) of the lists of more than `most` rows."""
    sizes = rows.groupBy("list").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > most)
    return sizes.select("list", F.ceil(F.col("size") / F.lit(most // 2)).cast("int").alias("blocks"))


def _without(rows: DataFrame, lists: DataFrame) -> DataFrame:
    return rows.join(lists.select("list"), "list", "left_anti")


def simhash_links(classes: DataFrame, limit: int = 4, fp_col: str = "fp", cell: int = CELL) -> DataFrame:
    """(v, component) of the fingerprints that link with others: v and the least fingerprint in reach, as longs.

    `classes` has one row for each distinct fingerprint; two link if they differ in `limit` bits or fewer.  Exact, without all pairs of
    a list; see the module's text.
    """
    plan = plan_for(classes, limit, fp_col)
    rows = staged(probes(classes, plan, fp_col), "probes")
    long = staged(_long_lists(rows, cell), "long-lists")
    if not long.count():
        return connected_components(links_in_lists(rows, limit, cell))
    edges = staged(links_in_lists(_without(rows, long), limit, cell), "links")
    crowded = spread_join(rows, long.select("list"), ["list"], "fp", root_of(rows))
    rows = staged(refined(crowded, plan, limit).distinct(), "refined")
    long = staged(_long_lists(rows, cell), "longer-lists")
    edges = edges.union(staged(links_in_lists(_without(rows, long), limit, cell), "links"))
    if not long.count():
        return connected_components(edges)
    # Blocks differ from list to list, so that members that one list parts may meet in another.
    block = F.pmod(F.xxhash64("fp", "list"), F.col("blocks")).cast("int")
    rows = staged(spread_join(rows, long, ["list"], "fp", root_of(rows)).withColumn("block", block), "blocks")
    diagonal = rows.select(F.xxhash64("list", "block").alias("list"), "fp")
    edges = staged(edges.union(links_in_lists(diagonal, limit, cell)), "links")
    known = staged(connected_components(edges), "known")
    rows = staged(rows.join(known.select(F.col("v").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "blocks")
    several = rows.groupBy("list").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("list")
    rows = spread_join(rows, several, ["list"], "fp", root_of(rows))
    other = F.explode(F.expr("filter(sequence(0, blocks - 1), k -> k <> block)"))
    cells = rows.select("list", "fp", "component", "block", other.alias("other"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    cells = cells.select(F.xxhash64("list", low, high).alias("list"), "fp", "component", (F.col("block") < F.col("other")).cast("int").alias("left"))
    crossing = staged(_links_across(cells, limit, cell), "crossing")
    return connected_components(edges.union(crossing))


def _links_across(cells: DataFrame, limit: int, most: int) -> DataFrame:
    """(a, b): links between the two sides of each cell (list, fp, component, left), across components, that span what they join."""
    schema = arrow_schema("a long, b long")

    def run(batches):
        for lists, fps, component, left in _whole_lists(batches, 4, 2 * most):
            starts = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]]))
            for lo, hi in zip(starts, [*starts[1:], len(lists)]):
                x = np.flatnonzero(left[lo:hi] == 1) + lo
                y = np.flatnonzero(left[lo:hi] == 0) + lo
                label = np.unique(component[lo:hi], return_inverse=True)[1].reshape(-1)
                for i in x:
                    j = y[label[y - lo] != label[i - lo]]
                    j = j[np.bitwise_count((fps[j] ^ fps[i]).view(np.uint64)) <= limit]
                    if len(j):
                        a, b = _joined(label, np.full(len(j), i - lo), j - lo)
                        yield pa.RecordBatch.from_arrays([pa.array(fps[a + lo]), pa.array(fps[b + lo])], schema=schema)

    return in_arrow(cells.repartition("list").sortWithinPartitions("list"), run, "a long, b long")


def simhash_components(
    docs: DataFrame, width: int = 4, limit: int = 4, id_col: str = "doc_id", text_col: str = "text", cell: int = CELL
) -> DataFrame:
    """One row a document: doc_id, fp (its fingerprint, a long), component_id and n_equal (rows with that fingerprint).

    Documents link if their fingerprints differ in `limit` bits or fewer; component_id is the smallest doc_id in reach, the row's own
    included, null ids last.  Texts of fewer than `width` words have one shingle, the whole sequence; null, empty and blank texts
    have fingerprint zero and link like others.  Repeated rows and equal texts are one class from the start.  An empty table gives
    an empty result; other columns are not read, so their names don't matter; long texts are hashed whole, in parts.
    """
    rows = staged(fingerprints(docs, width, id_col, text_col), "fingerprints")
    classes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_equal")), "classes")
    known = simhash_links(classes.select("fp"), limit, cell=cell)
    grouped = classes.join(known.select(F.col("v").alias("fp"), "component"), "fp", "left")
    grouped = staged(grouped.filter("component is not null or n_equal > 1").withColumn("component", F.coalesce("component", "fp")), "groups")
    ids = grouped.groupBy("component").agg(F.min("least").alias("id"))
    named = spread_join(grouped, ids, ["component"], "fp", root_of(grouped)).select("fp", "id", "n_equal")
    # As spread_join, but rows without a group stay: a fingerprint may be that of a third of all rows.
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(root_of(rows))))
    parts = dealt.select("fp", "salt").distinct().join(named, "fp")
    return dealt.join(parts, ["fp", "salt"], "left").select(
        "doc_id", "fp", F.coalesce("id", "doc_id").alias("component_id"), F.coalesce("n_equal", F.lit(1)).cast("long").alias("n_equal")
    )


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents: four-word shingles, four bits."""
    found = simhash_components(texts_of(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_equal")
