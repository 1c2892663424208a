"""N-gram Jaccard join with token-combination prefixes.

A document's set holds its distinct word shingles as 64-bit fingerprints, ordered by fingerprint.  For a
threshold t two sets x and y are similar if they share at least a(x, y) = t / (1 + t) * (|x| + |y|) tokens.
With n = |x|, E(n) = n - ceil(t n) tokens may be missing; the prefix of x extended by k is its first
E(n) + k(n) tokens, and two similar sets share at least min(k) tokens within their extended prefixes.

Each token of a prefix is rare (in at most `rare` prefixes) or frequent.

* Rare tokens are indexed singly.  The pairs that a token's list gives are counted by pair; with f(x) frequent
  tokens in the prefix of x, a similar pair shares at least min(k) - min(f) rare tokens, which prunes
  pairs that share a passage by chance.  Here k(n) = E(n) / 3 + 2.
* If a similar pair shares no rare token, the first min(k) tokens that it shares are all frequent.  So only a set
  whose f(x) reaches the least k of its partners needs more: it is heavy.

Heavy sets are few.  They are read whole, and their tokens are put in order anew, rarest first among these
sets.  Shared rare tokens are indexed singly again.  A pair that shares none of these has all its common tokens
among the frequent ones, so only a set's frequent tokens and its size bear on it: sets with the same frequent tokens
are one group, and its least set stands for it, as what links with another set links with that one too.  Of the gaps
between the common tokens of a pair, each token that only one set holds breaks one; over an unbroken gap two
consecutive frequent tokens are the same in both sets.  So a similar pair has many common combinations of two
consecutive frequent tokens, and by the prefix principle each group need index only its rarest combinations, all
but that number less one.

A list of a combination gives a star at first: its groups are compared with its head.  Once the links found
so far are joined to components, only groups of different components in one list are compared further.  Of
two sets one must be rich in frequent tokens, so pages that share a template and nothing else are not compared at
all; the rest of a long list is dealt out in cells.  A group's sets too large to link with its least one are told
the partner that leaves most room.  So no list gives all pairs of a family, and no link between components is lost.

Candidates with a common rare token are verified on whole sets, the others on all their frequent tokens.  Equal sets are one class from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, arrow_schema, discard, in_arrow, parts_of, root_of, spread_join, staged, texts_of, utf8
from .components import connected_components

#: Prefixes that hold a rare token, at most; also the longest list that gives all pairs.
RARE = 20
#: Bits of the filter that is sent to the second reading of the texts.
FILTER_BITS = 1 << 26
#: Sets on each side of a cell, about, when members of one list are compared.
CELL = 512
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Shingler:
    """Distinct `width`-word shingles of a lower-cased (A-Z) text as sorted 64-bit fingerprints."""

    def __init__(self, width: int):
        self.width = width
        self.memory = Memo(xxhash.xxh3_64_intdigest)

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        self.memory.trim()
        h = np.fromiter(map(self.memory.__getitem__, words), np.uint64, len(words))
        k = min(self.width, len(h))
        # A short sequence is one shingle of its own kind.
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = (out ^ h[i : len(h) - k + 1 + i]) * _M1
            out ^= out >> np.uint64(29)
            out *= _M2
            out ^= out >> np.uint64(32)
        return np.unique(out)


def missing(n, percent: int):
    """E(n)."""
    return n - -(-percent * n // 100)


def prefix_length(n: int, percent: int) -> int:
    """E(n) + k(n)."""
    return min(n, missing(n, percent) + missing(n, percent) // 3 + 2)


def _k(n: str, percent: int) -> str:
    """k(n) in SQL."""
    return f"(({n} - ({percent} * {n} + 99) div 100) div 3 + 2)"


def _key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return (h >> 64) - (1 << 63), (h & (2**64 - 1)) - (1 << 63)


def _sets(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, row_col: str | None) -> DataFrame:
    """row, doc_id, text key, set size and key, and extended prefix of every document."""
    source = docs.select(
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"),
        F.col(id_col).alias("doc_id"),
        utf8(text_col).alias("t"),
        F.xxhash64(utf8(text_col)).alias("tk"),
    )
    kind = source.schema["doc_id"].dataType.simpleString()
    ddl = f"row long, doc_id {kind}, tk long, n long, k1 long, k2 long, prefix array<long>"
    schema = arrow_schema(ddl)

    def run(batches):
        shingle = Shingler(width)
        for batch in parts_of(batches):
            n, k1, k2, lists, ends = [], [], [], [], [0]
            for text in batch.column(2).to_pylist():
                s = shingle(text)
                p = s[: prefix_length(len(s), percent)]
                a, b = _key(s)
                n.append(len(s))
                k1.append(a)
                k2.append(b)
                lists.append(p)
                ends.append(ends[-1] + len(p))
            # With the top bit turned over, signed longs stand in the order of the fingerprints.
            flat = (np.concatenate(lists) ^ np.uint64(1 << 63)).view(np.int64) if lists else np.zeros(0, np.int64)
            prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)).cast(schema.field("prefix").type)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).cast(schema.field("doc_id").type), batch.column(3),
                 *[pa.array(c, pa.int64()) for c in (n, k1, k2)], prefix],
                schema=schema,
            )

    return source.transform(in_arrow, run, ddl)


def _whole_sets(docs: DataFrame, wanted: DataFrame, text_col: str, width: int) -> DataFrame:
    """(row, s array<long>): the sets of `wanted` (row, tk, k1, k2), from a second reading of the texts.

    A bit map of FILTER_BITS bits over the wanted text keys, of fixed size, is broadcast; it lets through all wanted
    texts and few others, which the join then drops.  Copies within a task are sent once.
    """
    spark = docs.sparkSession
    cell = F.pmod(F.col("tk"), F.lit(FILTER_BITS))
    words = (
        wanted.groupBy(F.shiftright(cell, 6).alias("i"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(tk, {FILTER_BITS}) & 63 as int))")).alias("b"))
        .toArrow()
    )
    bits = np.zeros(FILTER_BITS >> 6, np.int64)
    bits[words.column("i").to_numpy()] = words.column("b").to_numpy()
    sent = spark.sparkContext.broadcast(bits.view(np.uint64))
    ddl = "k1 long, k2 long, s array<long>"
    schema = arrow_schema(ddl)

    def run(batches):
        bits, shingle, done = sent.value, Shingler(width), set()
        for batch in parts_of(batches):
            tk = batch.column(1).to_numpy()
            c = np.mod(tk, FILTER_BITS)
            hit = np.flatnonzero(bits[c >> 6] >> (c & 63).astype(np.uint64) & np.uint64(1))
            out = []
            for i in hit.tolist():
                if len(done) > 1_000_000:
                    done.clear()
                if tk[i] not in done:
                    done.add(tk[i])
                    s = shingle(batch.column(0)[i].as_py())
                    out.append((*_key(s), s.view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    found = docs.select(utf8(text_col).alias("t"), F.xxhash64(utf8(text_col)).alias("tk")).transform(in_arrow, run, ddl)
    once = found.groupBy("k1", "k2").agg(F.first("s").alias("s"))
    return once.join(wanted.select("row", "k1", "k2"), ["k1", "k2"]).select("row", "s")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of rows whose sets are similar."""
    both = pairs.join(sets.select(F.col("row").alias("a"), F.col("s").alias("sa")), "a").join(
        sets.select(F.col("row").alias("b"), F.col("s").alias("sb")), "b"
    )
    same = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * same >= percent * (F.size("sa") + F.size("sb") - same)).select("a", "b")


def _all_pairs(lists: str) -> str:
    """SQL for the ordered pairs of an array of (n, row) sorted by n."""
    return (
        f"flatten(transform({lists}, (x, i) -> transform(slice({lists}, i + 2, size({lists})), "
        "y -> struct(least(x.row, y.row) as a, greatest(x.row, y.row) as b, x.n as n, y.n as m))))"
    )


def jaccard_links(
    docs: DataFrame,
    percent: int = 90,
    width: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    rare: int = RARE,
    row_col: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The classes, links and components of a similarity join: (documents, classes, links, components).

    documents: row, doc_id, n, class (the first row with the same set).  classes: the rows that stand for a
    class, with size and the class's least doc_id.  links: verified pairs (a, b) of classes that connect all that
    are similar; inside a large family further links are implied by its component and not listed.  components:
    (v, component) of all classes with a link.

    Texts without words, null ones too, have an empty set, are each a class of their own row, and link with nothing.
    Null ids are documents like any other but never name a component.  Repeated rows fall into one class.  An empty table
    gives empty results.  Texts are taken whole, however long; a set stands as one array in one row.  Other columns of
    `docs` are not read, so their names don't matter.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    sets = staged(_sets(docs, id_col, text_col, width, percent, row_col), "sets")
    classes = sets.filter("n > 0").groupBy("k1", "k2").agg(
        F.min(F.struct("row", "tk", "n", "prefix")).alias("x"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies")
    )
    wide = staged(classes.select("x.row", "x.tk", "x.n", "x.prefix", "k1", "k2", "least_id", "copies"), "classes")
    rows = staged(sets.select("row", "doc_id", "n", "k1", "k2"), "rows")
    filled = rows.filter("n > 0")
    discard(sets)

    entries = wide.select("row", "n", F.explode("prefix").alias("token"))
    df = entries.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    # Most tokens are in one prefix; the others are written once for both uses.
    shared = staged(entries.join(df, "token"), "shared")
    classes = staged(wide.drop("prefix"), "classes")
    discard(wide)
    # Rare lists have at most `rare` members.
    lists = shared.filter(F.col("df") <= rare).groupBy("token").agg(
        F.sort_array(F.collect_list(F.struct("n", "row"))).alias("m")
    )
    fits = F.col("p.n") * 100 >= F.col("p.m") * percent
    rare_pairs = (
        lists.select(F.explode(F.expr(_all_pairs("m"))).alias("p"))
        .filter(fits)
        .groupBy("p.a", "p.b")
        .agg(F.min("p.n").alias("n"), F.count(F.lit(1)).alias("common"))
    )
    # A prefix bounds each of these lists.
    frequent = staged(
        shared.filter(F.col("df") > rare)
        .groupBy("row", "n")
        .agg(F.sort_array(F.collect_list("token")).alias("tokens")),
        "frequent",
    )
    f = frequent.select("row", F.size("tokens").alias("f"))
    least = F.expr(_k("n", percent))  # of the smaller set
    rare_pairs = (
        rare_pairs.join(f.select(F.col("row").alias("a"), F.col("f").alias("fa")), "a", "left")
        .join(f.select(F.col("row").alias("b"), F.col("f").alias("fb")), "b", "left")
        .filter(F.col("common") + F.least(F.coalesce("fa", F.lit(0)), F.coalesce("fb", F.lit(0))) >= least)
        .select("a", "b")
    )
    # The smallest partner of a set of n has ceil(percent * n / 100) tokens.
    partner = f"(({percent} * n + 99) div 100)"
    heavy = frequent.filter(F.expr(f"size(tokens) >= {_k(partner, percent)}"))
    heavy = Heavy(docs, classes, heavy.select("row"), text_col, width, percent, rare)
    pairs = staged(rare_pairs if heavy.empty else rare_pairs.union(heavy.singles).distinct(), "pairs")
    links = _links(docs, classes, pairs, text_col, width, percent, "links")
    discard(shared, frequent)
    if not heavy.empty:
        discard(heavy.shared)
        links = links.union(heavy.links)
    named = connected_components(links)
    late = heavy.late_links(named)
    if late is not None:
        links = links.union(late)
        named = connected_components(links)
    # Only classes with copies need the join; their rows are split by Spark's skew handling if one is hot.
    several = classes.filter("copies > 1").select("k1", "k2", F.col("row").alias("class"))
    documents = filled.select("row", "doc_id", "n", "k1", "k2").join(several, ["k1", "k2"], "left").select(
        "row", "doc_id", "n", F.coalesce("class", "row").alias("class")
    )
    documents = documents.union(rows.filter("n = 0").select("row", "doc_id", "n", F.col("row").alias("class")))
    classes = classes.select(F.col("row").alias("class"), "n", "least_id", "copies", "tk", "k1", "k2")
    return documents, classes, links, named


def _may_link(common, total, percent: int):
    """Whether two sets of `total` tokens together are similar if they share `common`."""
    return (100 + percent) * common >= percent * total


class Heavy:
    """Links among sets whose prefixes are mostly frequent tokens.

    These few sets are taken whole, and their tokens are ordered anew by how many of these sets hold them, rarest
    first.  All shared rare tokens are indexed, so a pair's number of common rare tokens is exact and with the
    least number of frequent tokens bounds what it shares: `singles` are the pairs left, still to be verified.
    `links` are verified ones of pairs that share enough frequent tokens; late_links() gives all that is missing then.
    """

    def __init__(self, docs, classes, heavy, text_col, width, percent, rare):
        self.percent = percent
        wanted = staged(classes.select("row", "tk", "k1", "k2").join(heavy, "row", "left_semi"), "heavy")
        self.empty = wanted.isEmpty()
        if self.empty:
            return
        sets = staged(_whole_sets(docs, wanted, text_col, width), "heavy-sets")
        self.salts = root_of(sets)
        tokens = sets.select("row", F.size("s").cast("long").alias("n"), F.explode("s").alias("token"))
        df = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
        self.shared = staged(spread_join(tokens, df, ["token"], "row", self.salts), "heavy-shared")
        discard(sets, wanted)
        # A set's own tokens bound this list.
        frequent = (
            self.shared.filter(F.col("df") > rare)
            .groupBy("row", "n")
            .agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "token"))), lambda x: x["token"]).alias("tokens"))
            .withColumn("f", F.size("tokens").cast("long"))
            .withColumns({"g1": F.xxhash64(F.lit(1), "tokens"), "g2": F.xxhash64(F.lit(2), "tokens")})
        )
        self.frequent = staged(frequent, "heavy-frequent")
        self.singles = self._singles(rare)
        self._group()
        self._index()

    def _may(self, common, total):
        return _may_link(common, total, self.percent)

    def _singles(self, rare) -> DataFrame:
        f = self.frequent.select("row", "f")
        least_f = F.least(F.coalesce("fa", F.lit(0)), F.coalesce("fb", F.lit(0)))
        return (
            self.shared.filter(F.col("df") <= rare)
            .groupBy("token")
            .agg(F.sort_array(F.collect_list(F.struct("n", "row"))).alias("m"))
            .select(F.explode(F.expr(_all_pairs("m"))).alias("p"))
            .filter(F.col("p.n") * 100 >= F.col("p.m") * self.percent)
            .groupBy("p.a", "p.b")
            .agg(F.min(F.col("p.n") + F.col("p.m")).alias("total"), F.count(F.lit(1)).alias("common"))
            .join(f.select(F.col("row").alias("a"), F.col("f").alias("fa")), "a", "left")
            .join(f.select(F.col("row").alias("b"), F.col("f").alias("fb")), "b", "left")
            .filter(self._may(F.col("common") + least_f, F.col("total")))
            .select("a", "b")
        )

    def _group(self) -> None:
        """groups: row, n and f of the least set with some frequent tokens, and sizes of those too large to link with it (if any).

        members: the other sets of each group (member, m_n; near: whether it links with the least one, named row).
        """
        # All that a pair without a common rare token shares is frequent; a set with too few frequent tokens has no such partner.
        able = self.frequent.filter(F.expr(f"f >= ({self.percent} * n + 99) div 100"))
        least = staged(
            able.groupBy("g1", "g2").agg(F.min(F.struct("n", "row")).alias("x"), F.min("f").alias("f"))
            .select("g1", "g2", F.col("x.row").alias("row"), F.col("x.n").alias("n"), "f"),
            "heavy-least",
        )
        others = able.select(F.col("row").alias("member"), F.col("n").alias("m_n"), "g1", "g2")
        others = spread_join(others, least, ["g1", "g2"], "member", self.salts).filter("member <> row")
        near = self._may(F.col("f"), F.col("n") + F.col("m_n"))
        self.members = staged(others.select("row", "member", "m_n", near.alias("near")), "heavy-members")
        far = self.members.filter(~F.col("near")).groupBy("row").agg(F.min("m_n").alias("far"), F.max("m_n").alias("farthest"))
        self.groups = staged(least.drop("g1", "g2").join(far, "row", "left"), "heavy-groups")
        discard(least)

    def _index(self) -> None:
        """indexed: each group in the lists of its rarest combinations, those of two groups or more; and links of first stars."""
        p = self.percent
        # A similar pair has `least` tokens in common, and of the gaps between them it breaks one with each token that only
        # one of them holds; the rest are common combinations.
        common = lambda n: F.expr(f"(({p} * {n} + 99) div 100) - 1 - ({100 - p} * {n} div {p})")
        # A group asks for what any of its sets needs; in between the number may fall by one.
        asked = F.when(F.col("far").isNull(), common("n")).otherwise(
            F.least(common("n"), common("coalesce(far, n)"), common("coalesce(farthest, n)")) - 1
        )
        keys = "transform(slice(tokens, 1, size(tokens) - 1), (t, i) -> xxhash64(t, tokens[i + 1]))"
        if p < 67:
            # Small sets may share no combination; these have their single tokens indexed too.
            keys = f"concat({keys}, if(asked < 1, transform(tokens, t -> xxhash64(t)), slice(array(0L), 1, 0)))"
        groups = self.groups.withColumn("asked", asked).join(self.frequent.select("row", "tokens"), "row")
        combos = groups.select("row", "n", "f", "far", "asked", F.explode(F.expr(keys)).alias("combo"))
        counts = combos.groupBy("combo").agg(F.count(F.lit(1)).alias("df"))
        # All but the number of common combinations, less one, are indexed, rarest first; everything, if there may be none.
        combos = staged(
            spread_join(combos, counts, ["combo"], "row", self.salts)
            .groupBy("row", "n", "f", "far", "asked")
            .agg(F.sort_array(F.collect_list(F.struct("df", "combo"))).alias("m"))  # a set's own tokens bound it
            .select(
                "row", "n", "f", "far",
                F.explode(F.expr("slice(m, 1, cast(if(asked < 1, size(m), greatest(0, f - asked)) as int))")).alias("m"),
            )
            .select("row", "n", "f", "far", F.col("m.combo").alias("combo")),
            "combinations",
        )
        # The member with the fewest rare tokens is the likeliest to be what the others were copied from.
        heads = combos.groupBy("combo").agg(
            F.count(F.lit(1)).alias("df"), F.min(F.struct(F.col("n") - F.col("f"), "row")).alias("hub")
        )
        heads = heads.filter("df > 1").select("combo", F.col("hub.row").alias("hub"))
        self.indexed = staged(spread_join(combos, heads, ["combo"], "row", self.salts), "indexed")
        discard(combos)
        # Of the heads of its lists, each member is compared with the one that it shares most lists with.
        stars = (
            self.indexed.filter("row <> hub")
            .groupBy("row", "hub")
            .agg(F.count(F.lit(1)).alias("c"))
            .groupBy("row")
            .agg(F.max_by("hub", F.struct("c", -F.col("hub"))).alias("hub"))
            .select(F.col("row").alias("a"), F.col("hub").alias("b"))
        )
        own = self.members.filter("near").select(F.col("row").alias("a"), F.col("member").alias("b"))
        linked = self._shared_by(stars).filter(self._may(F.col("o"), F.col("na") + F.col("nb"))).select("a", "b")
        self.links = staged(linked.union(own), "heavy-links")

    def _shared_by(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b, ...) with o, the number of frequent tokens in common, and the sizes na and nb."""
        sets = self.frequent.select("row", "n", "tokens")
        side = lambda x: sets.select(F.col("row").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}"))
        both = spread_join(spread_join(pairs, side("a"), ["a"], "b", self.salts), side("b"), ["b"], "a", self.salts)
        return both.withColumn("o", F.size(F.array_intersect("ta", "tb")).cast("long")).drop("ta", "tb")

    def _with_hub(self, listed: DataFrame) -> DataFrame:
        """listed with h, the number of frequent tokens that a group has in common with the head of the list.

        Each token that two groups share is the head's too or one that neither has in common with it, so they share at most
        the lesser h and the lesser f - h.
        """
        listed = staged(listed, "open")
        asked = listed.filter("row <> hub").select(F.col("row").alias("a"), F.col("hub").alias("b")).distinct()
        shared = self._shared_by(asked).select(F.col("a").alias("row"), F.col("b").alias("hub"), F.col("o").alias("h"))
        # A row and a head stand in as many lists as the row has combinations, at most.
        return staged(listed.join(shared, ["row", "hub"], "left").withColumn("h", F.coalesce("h", "f")), "listed-hub")

    def _in_reach(self, asking: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Those rows of both that may link with some row of the other side in their list, by the h of one and f - h of the other.

        That bound less what a pair must share is a sum of one part from each side, so a list's greatest part of the other side decides.
        """
        p = self.percent
        near = (100 + p) * F.col("h") - p * F.col("n")
        off = (100 + p) * (F.col("f") - F.col("h")) - p * F.col("n")

        def kept(rows, others, name):
            best = others.groupBy("combo").agg(F.max(near).alias("near"), F.max(off).alias("off"))
            met = spread_join(rows, best, ["combo"], "row", self.salts)
            return staged(met.filter((near + F.col("off") >= 0) & (off + F.col("near") >= 0)).drop("near", "off"), name)

        asking = kept(asking, listed, "asking")
        return asking, kept(listed, asking, "in-reach")

    def late_links(self, named: DataFrame) -> DataFrame | None:
        """Links that join what the components (v, component) of the links so far leave apart.

        Groups of one list and of different components are compared: each list's largest component with the others, and
        these among themselves; so are sets too large for their group's least one, with all groups of a list.  What two groups share
        with the list's head bounds what they share, so those that strayed from a family's head are not paired with its
        other members.  None if there are none such.
        """
        if self.empty:
            return None
        p = self.percent
        listed = self.indexed.join(named.withColumnRenamed("v", "row"), "row", "left")
        listed = listed.withColumn("c", F.coalesce("component", "row")).drop("component")
        # A set links with a larger one of n tokens if n <= 100 f / p + f - its own; that of poor ones is under their own size.
        listed = staged(listed.withColumn("rich", (100 + p) * F.col("f") >= 2 * p * F.col("n")), "listed")
        parts = listed.groupBy("combo", "c").agg(F.count(F.lit(1)).alias("k"), F.max(F.col("far").isNotNull()).alias("any_far"))
        main = parts.groupBy("combo").agg(
            F.max_by("c", F.struct("k", "c")).alias("main"), F.count(F.lit(1)).alias("parts"), F.max("any_far").alias("any_far")
        )
        main = main.filter("parts > 1 or any_far").drop("parts", "any_far")
        listed = self._with_hub(spread_join(listed, main, ["combo"], "row", self.salts))
        wants = F.explode(F.when(F.col("rich"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True))))
        # Sets too large for their own group are poor.
        asking = listed.filter("c <> main").select("combo", wants.alias("rich"), "row", "n", "f", "h", "c", F.lit(False).alias("far")).union(
            listed.filter("far is not null").select("combo", F.lit(True), "row", "far", "f", "h", F.lit(None).cast("long"), F.lit(True))
        )
        asking, listed = self._in_reach(asking, listed)
        if asking.isEmpty():
            return None
        keys = ["combo", "rich"]
        sizes = (
            asking.select(*keys, F.lit(1).alias("x"), F.lit(0).alias("y"))
            .union(listed.select(*keys, F.lit(0), F.lit(1)))
            .groupBy(*keys)
            .agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
            .filter("x > 0 and y > 0")
            .select(*keys, F.ceil(F.col("x") / CELL).alias("x"), F.ceil(F.col("y") / CELL).alias("y"))
        )
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = (
            spread_join(asking, sizes, keys, "row", self.salts)
            .withColumn("i", F.pmod(F.xxhash64("row"), F.col("x")))
            .select(*keys, "i", every("y").alias("j"), *[F.col(k).alias(f"s_{k}") for k in ("row", "n", "f", "h", "c", "far")])
        )
        right = (
            spread_join(listed, sizes, keys, "row", self.salts)
            .withColumn("j", F.pmod(F.xxhash64("row"), F.col("y")))
            .select(*keys, every("x").alias("i"), "j", "row", "n", "f", "h", "c")
        )
        pairs = (
            left.join(right, [*keys, "i", "j"])
            .filter(F.col("row") != F.col("s_row"))
            .filter(F.col("s_far") | (F.col("c") != F.col("s_c")))
            .filter(self._may(F.least("h", "s_h") + F.least(F.col("f") - F.col("h"), F.col("s_f") - F.col("s_h")), F.col("n") + F.col("s_n")))
            .select(F.col("s_row").alias("a"), F.col("row").alias("b"), F.col("s_far").alias("far"))
            .distinct()
        )
        found = staged(self._shared_by(pairs), "late")
        links = found.filter(~F.col("far") & self._may(F.col("o"), F.col("na") + F.col("nb"))).select("a", "b")
        # The partner that leaves most room for a set of these frequent tokens.
        room = (100 + p) * F.col("o") - p * F.col("nb")
        best = found.filter("far").groupBy(F.col("a").alias("row")).agg(F.max(F.struct(room.alias("room"), F.col("b").alias("b"))).alias("x"))
        far = self.members.filter(~F.col("near"))
        far = spread_join(far, best.select("row", "x.room", "x.b"), ["row"], "member", self.salts)
        far = far.filter(p * F.col("m_n") <= F.col("room")).select(F.col("member").alias("a"), "b")
        return staged(links.union(far), "late-links")


def _links(docs, classes, pairs, text_col, width, percent, name) -> DataFrame:
    ends = pairs.select(F.col("a").alias("row")).union(pairs.select(F.col("b").alias("row"))).distinct()
    wanted = staged(classes.select("row", "tk", "k1", "k2").join(ends, "row", "left_semi"), "wanted")
    sets = staged(_whole_sets(docs, wanted, text_col, width), "whole")
    links = staged(_verified(pairs, sets, percent), name)
    discard(sets, wanted)
    return links


#: Tokens of the sets on each side of a cell, about, when links are counted.
CELL_TOKENS = 1 << 16


def link_counts(
    docs: DataFrame,
    percent: int = 90,
    width: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    rare: int = RARE,
    row_col: str | None = None,
) -> DataFrame:
    """One row a document: row, doc_id, n_shingles, class, group and n_links, the exact number of other texts (classes) it is similar to.

    All links lie within groups.  The sets of a group are dealt over cells of two parts of about CELL_TOKENS tokens, and a cell
    lets out one number a set, so no pair is written and no link is lost; the work still grows with the square of a group's
    number of different texts, which is why op1 does without it.  Edge cases are those of jaccard_links().
    """
    documents, classes, _, named = jaccard_links(docs, percent, width, id_col, text_col, rare, row_col)
    grouped = classes.select(F.col("class").alias("row"), "n", "k1", "k2", "tk").join(named.withColumnRenamed("v", "row"), "row")
    grouped = staged(grouped.select("row", "n", "k1", "k2", "tk", F.col("component").alias("group")), "grouped")
    sets = staged(_whole_sets(docs, grouped, text_col, width), "group-sets")
    sizes = grouped.groupBy("group").agg(F.ceil(F.sum("n") / CELL_TOKENS).alias("parts"))
    dealt = spread_join(grouped.select("row", "group"), sizes, ["group"], "row", root_of(grouped)).join(sets, "row")
    dealt = dealt.withColumn("i", F.pmod(F.xxhash64("row"), F.col("parts")))
    # Each set is sent once to every cell of its part's row and column, upper half alone.
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    cells = dealt.withColumn("other", others).select(
        "group", F.least("i", "other").alias("i"), F.greatest("i", "other").alias("j"), (F.col("i") <= F.col("other")).alias("left"), "row", "s"
    )
    ddl = "row long, links long"
    schema = arrow_schema(ddl)

    def counts(a: list[np.ndarray], b: list[np.ndarray], same: bool) -> np.ndarray:
        """A table of a's sets by b's: whether they are similar."""
        flat = np.concatenate([*a, *b])
        _, token = np.unique(flat, return_inverse=True)
        sizes_ = np.array([len(x) for x in [*a, *b]])
        owner = np.repeat(np.arange(len(sizes_)), sizes_)
        in_a = owner < len(a)
        ta, oa = token[in_a], owner[in_a]
        tb, ob = token[~in_a], owner[~in_a] - len(a)
        order = np.argsort(tb, kind="stable")
        tb, ob = tb[order], ob[order]
        shared = np.zeros((len(a), len(b)), np.int64)
        lo, hi = np.searchsorted(tb, ta), np.searchsorted(tb, ta, "right")
        for o in range(len(a)):
            mine = np.flatnonzero(oa == o)
            n = hi[mine] - lo[mine]
            at = np.repeat(lo[mine] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            shared[o] = np.bincount(ob[at], minlength=len(b))
        total = sizes_[: len(a), None] + sizes_[None, len(a) :]
        hit = _may_link(shared, total, percent)
        if same:
            np.fill_diagonal(hit, False)
        return hit

    def run(batches):
        key, a, b = None, [], []

        def out():
            if key[1] == key[2]:
                hit = counts([x[1] for x in a], [x[1] for x in a], True)
                found = list(zip([x[0] for x in a], hit.sum(1).tolist()))
            elif a and b:
                hit = counts([x[1] for x in a], [x[1] for x in b], False)
                found = [*zip([x[0] for x in a], hit.sum(1).tolist()), *zip([x[0] for x in b], hit.sum(0).tolist())]
            else:
                found = []
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found), schema)], schema=schema) if found else None

        for batch in parts_of(batches):
            heads = zip(*[c.to_pylist() for c in batch.columns[:5]])
            for k, (group, i, j, left, row) in enumerate(heads):
                if (group, i, j) != key:
                    if key is not None and (done := out()) is not None:
                        yield done
                    key, a, b = (group, i, j), [], []
                (a if left else b).append((row, batch.column(5)[k].values.to_numpy()))
        if key is not None and (done := out()) is not None:
            yield done

    keys = ["group", "i", "j"]
    found = cells.repartition(*keys).sortWithinPartitions(*keys).transform(in_arrow, run, ddl).groupBy("row").agg(F.sum("links").alias("n_links"))
    linked = grouped.select(F.col("row").alias("class"), "group").join(found.withColumnRenamed("row", "class"), "class")
    return documents.join(linked, "class", "left").select(
        "row", "doc_id", F.col("n").alias("n_shingles"), "class", F.coalesce("group", "class").alias("group"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def jaccard_components(
    docs: DataFrame,
    percent: int = 90,
    width: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    rare: int = RARE,
    row_col: str | None = None,
) -> DataFrame:
    """One row a document: row, doc_id, n_shingles, class, component_id, group and linked.

    component_id is the least doc_id in reach by links or equal sets, group names the component by one of its
    rows, linked tells whether the group has a second row.  `row_col` names a column of unique longs that
    becomes row; without it rows are numbered in scan order.
    """
    documents, classes, _, named = jaccard_links(docs, percent, width, id_col, text_col, rare, row_col)
    # One row for each class that has a link or a copy.
    grouped = classes.join(named.withColumnRenamed("v", "class"), "class", "left").filter(
        "component is not null or copies > 1"
    )
    grouped = staged(grouped.select("class", "least_id", F.coalesce("component", "class").alias("group")), "groups")
    ids = grouped.groupBy("group").agg(F.min("least_id").alias("id"))
    known = grouped.join(ids, "group").select("class", "group", "id", F.lit(True).alias("linked"))
    return documents.join(known, "class", "left").select(
        "row",
        "doc_id",
        F.col("n").alias("n_shingles"),
        "class",
        F.coalesce("id", "doc_id").alias("component_id"),
        F.coalesce("group", "class").alias("group"),
        F.coalesce("linked", F.lit(False)).alias("linked"),
    )


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of all documents: three-word shingles, similarity 0.9."""
    return jaccard_components(texts_of(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


OP1_SQL = r"""
WITH RECURSIVE
w AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT r, s FROM (
        SELECT r, unnest([array_to_string(w[i:i+2], ' ') FOR i IN range(1, len(w) - 1)]) AS s FROM w WHERE len(w) >= 3
        UNION ALL SELECT r, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 2)),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
c AS (SELECT x.r AS a, y.r AS b, count(*) AS k FROM g x JOIN g y ON x.s = y.s AND x.r < y.r GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * k >= 90 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t AS (SELECT r AS v, r AS x FROM w UNION SELECT t.v, e.b FROM t JOIN e ON e.a = t.x),
m AS (SELECT t.v, min(w.doc_id) AS component_id FROM t JOIN w ON w.r = t.x GROUP BY t.v)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM w JOIN m ON m.v = w.r LEFT JOIN n ON n.r = w.r
"""
