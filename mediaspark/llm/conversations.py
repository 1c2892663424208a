"""The trie of conversation prefixes, from the chains of prefixes that each conversation owns.

A node is a distinct sequence of first turns; its members are the conversations that begin with it, and the smallest member owns it.  If
a conversation owns one of its prefixes it owns all longer ones, so what it owns is a chain that begins at its first owned depth.

* Turns become digests; each conversation's prefixes become chained digests, streamed in order with no conversation held whole.
* The owner of a digest is the least conversation under it.  All conversations search their first owned depth at once by
  bisection: a round joins the digests at their middle depths with the owners.  The last depth that failed is the parent's, and its
  owner is the chain that theirs hangs on.
* Chains are added up bottom-up by pointer jumping: after k rounds a chain holds the sums of the chains less than 2^k levels under
  it.  Within a chain a node's sums are those of its suffix and of what hangs on it.

All sums are of whole numbers: conversations that end in a subtree, code points on the path to each of them, code points of the nodes, and
leaves.  With n(v) members, c(v) code points in the last turn and p(v) on the whole path to v, the saved code points of a
subtree under x are the sum of (n(v) - 1) c(v), which is sum(p(end)) - n(x) (p(x) - c(x)) - sum(c(v)).
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_schema, in_arrow, root_of, spread_join, staged, table

#: Bytes of joined ids that a row carries.
CHUNK = 1 << 20
SUMS = ("ends", "path", "points", "leaves")


def turn_digests(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, digest, points) of each turn: its place from 0, a 128-bit digest of role and text, code points of the text.

    Turns are in order of `turn`, null first; equal ones in order of their digests.  A null role or text is an empty one; rows without
    a conversation are left out.
    """
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("points")
    )
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return rows.select("conv", (F.row_number().over(order) - 1).alias("pos"), "digest", "points")


def rebuilt(turns: DataFrame, base: Column, shared: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations with the first `shared` turns of another one before what they have after their own first `shared` turns.

    turns: (conv, pos, digest, points); base and shared: columns of conv.  Gives (conv) of all conversations, those without
    any turn left too, and the new turns, in order of pos but with gaps.
    """
    convs = turns.select("conv").distinct().select("conv", base.alias("base"), shared.alias("shared"))
    convs = staged(convs, "conversations")
    own = turns.filter(F.col("pos") >= shared)
    wanted = convs.filter("shared > 0").select(F.col("conv").alias("for"), F.col("base").alias("conv"), "shared")
    first = turns.join(wanted.groupBy("conv").agg(F.max("shared").alias("most")), "conv").filter("pos < most")
    lent = spread_rows(wanted, first).filter("pos < shared").select(F.col("for").alias("conv"), "pos", "digest", "points")
    return convs.select("conv"), own.union(lent)


def spread_rows(wanted: DataFrame, first: DataFrame) -> DataFrame:
    """wanted joined with the first turns of its conversations, gathered to one row each: no more than the turns that some one shares."""
    gathered = first.groupBy("conv").agg(F.collect_list(F.struct("pos", "digest", "points")).alias("turns"))
    joined = spread_join(wanted, gathered, ["conv"], "for", root_of(wanted))
    return joined.select("for", "shared", F.explode("turns").alias("t")).select("for", "shared", "t.*")


def prefix_digests(turns: DataFrame) -> DataFrame:
    """(conv, depth, digest, points, path): chained digests of each conversation's prefixes, from depth 1 on.

    `points` are those of the last turn, `path` those of all turns so far.  A task streams its conversations in order and holds one state.
    """
    ddl = "conv long, depth long, digest binary, points long, path long"
    schema = arrow_schema(ddl)

    def run(batches):
        last, depth, path, state = None, 0, 0, b""
        for batch in batches:
            convs, digests, points = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out = []
            for conv, digest, n in zip(convs, digests, points):
                if conv != last:
                    last, depth, path, state = conv, 0, 0, b""
                state = hashlib.blake2b(state + digest, digest_size=16).digest()
                depth, path = depth + 1, path + n
                out.append((conv, depth, state, n, path))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    return in_arrow(turns.repartition("conv").sortWithinPartitions("conv", "pos"), run, ddl)


def first_owned(convs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(conv, depth, first, parent): turns, first owned depth (depth + 1: none), and the owner of the prefix one turn shorter.

    The root is that of the least conversation, whose first depth is 0 and whose parent is null.  Each round halves the depths
    left to every conversation, so there are as many rounds as the longest one's number of turns has bits.
    """
    owners = staged(prefixes.groupBy("digest").agg(F.min("conv").alias("owner")), "owners")
    root = convs.agg(F.min("conv").alias("root"))
    depths = prefixes.groupBy("conv").agg(F.max("depth").alias("depth"))
    state = convs.join(depths, "conv", "left").crossJoin(F.broadcast(root))  # one row
    depth = F.coalesce("depth", F.lit(0)).cast("long")
    is_root = F.col("conv") == F.col("root")
    low = F.when(is_root, 0).otherwise(1).cast("long")
    state = staged(
        state.select("conv", depth.alias("depth"), low.alias("low"), F.when(is_root, 0).otherwise(depth + 1).cast("long").alias("high"), F.when(~is_root, F.col("root")).alias("parent")),
        "search",
    )
    salts = root_of(convs)
    done = []
    while True:
        open_ = state.filter("low < high")
        done.append(state.filter("low >= high"))
        if open_.isEmpty():
            break
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("long")
        # low <= middle < high <= depth + 1, so each conversation has a prefix of that depth.
        asked = open_.withColumn("middle", middle).join(prefixes.select("conv", F.col("depth").alias("middle"), "digest"), ["conv", "middle"])
        told = spread_join(asked, owners, ["digest"], "conv", salts)
        owned = F.col("owner") == F.col("conv")
        state = staged(
            told.select(
                "conv", "depth", F.when(owned, F.col("low")).otherwise(F.col("middle") + 1).alias("low"),
                F.when(owned, F.col("middle")).otherwise(F.col("high")).alias("high"), F.when(owned, F.col("parent")).otherwise(F.col("owner")).alias("parent"),
            ),
            "search",
        )
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out.select("conv", "depth", F.col("low").alias("first"), "parent")


def subtree_sums(chains: DataFrame, sums: tuple[str, ...]) -> DataFrame:
    """chains (conv, parent, and `sums`) with each sum taken over the chain and all chains that hang on it, however far down.

    Pointer jumping: a round adds the sums of what jumps to a chain to it and doubles all jumps, so the rounds are the logarithm of
    the levels.
    """
    state = staged(chains.withColumn("jump", F.col("parent")), "chains")
    salts = root_of(state)
    while not state.filter("jump is not null").isEmpty():
        moving = state.filter("jump is not null")
        added = moving.groupBy("jump").agg(*[F.sum(c).alias(f"{c}_more") for c in sums]).withColumnRenamed("jump", "conv")
        further = state.select(F.col("conv").alias("jump"), F.col("jump").alias("next"))
        jumps = spread_join(moving.select("conv", "jump"), further, ["jump"], "conv", salts).select("conv", "next")
        state = state.drop("jump").join(added, "conv", "left").join(jumps, "conv", "left")
        state = staged(
            state.select(
                "conv", *[c for c in chains.columns if c not in ("conv", *sums)],
                *[(F.col(c) + F.coalesce(f"{c}_more", F.lit(0))).alias(c) for c in sums], F.col("next").alias("jump"),
            ),
            "chains",
        )
    return state.drop("jump")


def joined_digests(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and `sha256`: of each group the lower-case SHA-256 of its whole numbers in ascending order, joined by commas.

    Rows are dealt by ranges of (keys, value), so a large group spreads over tasks, which join its numbers to pieces of a
    megabyte; one task streams the pieces of a group through the hash and holds one of them.
    """
    ddl = ", ".join(f"{k} long" for k in keys) + ", part int, piece int, joined binary"
    schema = arrow_schema(ddl)

    def pieces(batches):
        group, part, piece, size, joined = None, 0, 0, 0, []
        out: list[tuple] = []

        def close():
            nonlocal piece, size, joined
            if joined:
                out.append((*group, part, piece, b",".join(joined)))
                piece, size, joined = piece + 1, 0, []

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *key, number, task in zip(*columns):
                if key != group:
                    close()
                    group, part, piece = key, task, 0
                text = str(number).encode()
                joined.append(text)
                size += len(text) + 1
                if size >= CHUNK:
                    close()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    hashed_ddl = ", ".join(f"{k} long" for k in keys) + ", sha256 string"
    hashed_schema = arrow_schema(hashed_ddl)

    def hashes(batches):
        group, state = None, None
        out: list[tuple] = []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *key, _, _, joined in zip(*columns):
                if key != group:
                    if group is not None:
                        out.append((*group, state.hexdigest()))
                    group, state = key, hashlib.sha256(joined)
                else:
                    state.update(b",")
                    state.update(joined)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), hashed_schema)], schema=hashed_schema)
                out = []
        if group is not None:
            out = [(*group, state.hexdigest())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), hashed_schema)], schema=hashed_schema)

    order = [*keys, value]
    dealt = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    found = in_arrow(dealt, pieces, ddl)
    return in_arrow(found.repartition(*keys).sortWithinPartitions(*keys, "part", "piece"), hashes, hashed_ddl)


def prefix_trie(turns: DataFrame, base: Column | None = None, shared: Column | None = None, **columns: str) -> DataFrame:
    """One row for each distinct prefix of the conversations, the empty one too.

    conv_id (its smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens (code points that
    one copy of each shared turn saves in the subtree) and ends_sha256 (of the members that end here, joined by commas).  `base` and
    `shared`, columns of `conv`, have conversations rebuilt first.  Turns are in order of `turn`, null first, equal ones by a digest of
    role and text; null roles and texts are empty; rows without a conv_id are left out; repeated rows are turns of their own;
    an empty table gives an empty result.  Other columns are not read, so their names don't matter.  A turn's text is hashed whole and
    then left behind; a conversation, however long, is streamed by one task.
    """
    digests = staged(turn_digests(turns, **columns), "turns")
    if base is None:
        convs, kept = digests.select("conv").distinct(), digests
    else:
        convs, kept = rebuilt(digests, base, shared)
    return _trie(staged(convs, "conversations"), staged(prefix_digests(kept), "prefixes"))


def _trie(convs: DataFrame, prefixes: DataFrame) -> DataFrame:
    found = staged(first_owned(convs, prefixes), "first-owned")
    chains = found.filter("first <= depth")
    # Where each conversation ends: in its own chain, or on another one's at its own number of turns.
    ending = found.select(F.when(F.col("first") <= F.col("depth"), F.col("conv")).otherwise(F.col("parent")).alias("at"), "depth", F.col("conv").alias("member"))
    ending = staged(ending, "ends")
    zero = F.lit(0).cast("long")
    ends = ending.groupBy(F.col("at").alias("conv"), "depth").agg(F.count(F.lit(1)).alias("ends"))
    hanging = chains.filter("parent is not null").select(F.col("parent").alias("conv"), (F.col("first") - 1).alias("depth"))
    hanging = hanging.groupBy("conv", "depth").agg(F.count(F.lit(1)).alias("chains"))
    own = prefixes.select("conv", "depth", "points", "path").join(chains.select("conv", "first"), "conv").filter("depth >= first").drop("first")
    root = chains.filter("first = 0").select("conv", zero.alias("depth"), zero.alias("points"), zero.alias("path"))
    nodes = own.union(root).join(ends, ["conv", "depth"], "left").join(hanging, ["conv", "depth"], "left").na.fill(0, ["ends", "chains"])
    nodes = nodes.join(chains.select("conv", F.col("depth").alias("last"), "first", "parent"), "conv")
    nodes = nodes.withColumn("leaf", ((F.col("depth") == F.col("last")) & (F.col("chains") == 0)).cast("long"))
    nodes = staged(nodes, "nodes")
    per_chain = nodes.groupBy("conv").agg(
        F.min("parent").alias("parent"), F.min("first").alias("first"), F.sum("ends").alias("ends"),
        F.sum(F.col("ends") * F.col("path")).alias("path"), F.sum("points").alias("points"), F.sum("leaf").alias("leaves"),
    )
    summed = subtree_sums(per_chain, SUMS).filter("parent is not null")
    below = summed.groupBy(F.col("parent").alias("conv"), (F.col("first") - 1).alias("depth")).agg(*[F.sum(c).alias(f"{c}_below") for c in SUMS])
    suffix = Window.partitionBy("conv").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    here = {"ends": F.col("ends"), "path": F.col("ends") * F.col("path"), "points": F.col("points"), "leaves": F.col("leaf")}
    full = nodes.join(below, ["conv", "depth"], "left")
    full = full.withColumns({f"{c}_sum": F.sum(here[c] + F.coalesce(f"{c}_below", zero)).over(suffix) for c in SUMS})
    hashes = joined_digests(ending.select(F.col("at").alias("conv"), "depth", "member"), ["conv", "depth"], "member")
    full = full.join(hashes, ["conv", "depth"], "left")
    saved = F.col("path_sum") - F.col("ends_sum") * (F.col("path") - F.col("points")) - F.col("points_sum")
    return full.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > F.col("first"), F.col("conv")).otherwise(F.col("parent")).alias("parent_conv_id"),
        F.col("ends_sum").alias("n_convs"),
        (F.col("chains") + (F.col("depth") < F.col("last")).cast("long")).alias("n_children"),
        F.col("leaves_sum").alias("n_leaves"),
        saved.alias("saved_tokens"),
        F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt with up to five first turns of one in a hundred of them."""
    shared = F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    return prefix_trie(table(spark, sf_dir, "conversations"), F.col("conv") - F.col("conv") % 100, shared)


OP13_SQL = r"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(strlen(r) || ':' || r || x)) - 1 AS pos, r, x FROM t),
k AS (SELECT c, c - c % 100 AS b,
             -- crc32 of the decimal digits: a byte comes in, then eight shifts.
             xor(list_reduce(list_prepend(4294967295::UBIGINT,
                     flatten(list_transform(string_split(c::VARCHAR, ''), lambda s: [ascii(s)::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT]))),
                 lambda a, v: xor(xor(a, v) >> 1, 3988292384::UBIGINT * (xor(a, v) & 1::UBIGINT))), 4294967295::UBIGINT) % 6 AS h
      FROM (SELECT DISTINCT c FROM t)),
rb AS (SELECT o.c, pos, r, x FROM o JOIN k ON k.c = o.c WHERE pos >= h
       UNION ALL SELECT k.c, o.pos, o.r, o.x FROM k JOIN o ON o.c = k.b AND o.pos < k.h),
q AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) AS d, r, x FROM rb),
p AS (SELECT c, d, length(x) AS len, md5(string_agg(strlen(r) || ':' || r || strlen(x) || ':' || x, '') OVER (PARTITION BY c ORDER BY d)) AS key FROM q
      UNION ALL SELECT c, 0, 0, '' FROM k),
n AS (SELECT d, key, min(c) AS conv_id, count(*) AS n_convs, min(len) AS len FROM p GROUP BY d, key),
u AS (SELECT n.d, n.key, n.conv_id, n.n_convs, n.len, up.key AS up FROM n LEFT JOIN p up ON up.c = n.conv_id AND up.d = n.d - 1),
ch AS (SELECT d - 1 AS d, up AS key, count(*) AS n_children FROM u WHERE d > 0 GROUP BY 1, 2),
f AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN ch ON ch.d = u.d AND ch.key = u.key),
s AS (SELECT p.d, p.key, sum((f.n_convs - 1) * f.len) AS saved, count(*) FILTER (f.n_children = 0) AS leaves
      FROM f JOIN p ON p.c = f.conv_id AND p.d <= f.d GROUP BY 1, 2),
e AS (SELECT p.d, p.key, sha256(string_agg(p.c::VARCHAR, ',' ORDER BY p.c)) AS h
      FROM p JOIN (SELECT c, max(d) AS d FROM p GROUP BY c) m ON m.c = p.c AND m.d = p.d GROUP BY 1, 2)
SELECT f.conv_id, f.d AS depth, par.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.leaves AS n_leaves,
       s.saved::BIGINT AS saved_tokens, coalesce(e.h, sha256('')) AS ends_sha256
FROM f JOIN s ON s.d = f.d AND s.key = f.key LEFT JOIN n par ON par.d = f.d - 1 AND par.key = f.up
LEFT JOIN e ON e.d = f.d AND e.key = f.key
"""
