"""Language-model scores by prediction by partial matching (PPM) over bytes, beside a unigram word baseline.

The pretrained model is a trie of byte contexts up to three bytes long with the counts of the bytes that
followed them in all training texts.  A byte is coded in its longest context; a byte not seen there is coded after an
escape in the next shorter context, in which the bytes already ruled out are excluded; the last
resort is a uniform code over the bytes seen nowhere.  Escapes are estimated as method C: with t
occurrences of d distinct bytes, a byte seen c times has c / (t + d) and the escape d / (t + d).

In a pretrained trie the set excluded in a shorter context depends on the longer context alone, so the
chain of escapes is folded into one table: a row for each kept context, a column for each byte.  All contexts of
up to two bytes are kept there, and the common ones of three; bytes after any other context of three take
their probabilities from the counts of all training texts in a join.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import COUNTED, arrow_schema, in_arrow, kept_names, parts_of, remainder, staged, texts_of, utf8

ORDER = 3
#: Stands before a text's first byte and, as a symbol, for its end; no UTF-8 text holds it.
EDGE = 255
#: Contexts of three bytes in the table that is broadcast, at most: those with at least 1 / MAX_CONTEXTS of all occurrences.
MAX_CONTEXTS = 16_384
#: Words whose counts are broadcast, at most: those with at least 1 / MAX_COMMON of all training tokens.
MAX_COMMON = 200_000
#: Bytes of a word that is broadcast, at most.
COMMON_BYTES = 64
#: Whole numbers that stand for 1 in sums of logarithms, so that the order of adding doesn't matter.
FIXED = 10**10
_CHUNK = 1 << 20


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (three context bytes, byte) codes of lower-cased texts and their counts, the end of each text included."""
    edge = b"\xff"
    flat = np.frombuffer(b"".join([edge * 3 + t.lower() for t in texts]) + edge * 3, np.uint8).astype(np.uint32)
    code = (flat[:-3] << 24) | (flat[1:-2] << 16) | (flat[2:-1] << 8) | flat[3:]
    # After a text's end come two more edges whose codes say nothing.
    good = (flat[3:] != EDGE) | (flat[2:-1] != EDGE)
    # An empty text has its end right after the edges: one code of four edges.
    empty = sum(1 for t in texts if not t)
    codes, counts = np.unique(code[good], return_counts=True)
    if empty:
        codes = np.append(codes, np.uint32(0xFFFFFFFF))
        counts = np.append(counts, empty)
    return codes, counts


@dataclass
class Trie:
    """The folded table: log10 probabilities by row (context) and column (byte class)."""

    columns: np.ndarray  # byte -> column; bytes never seen share the last
    logp: np.ndarray  # rows x columns, float32
    rows: np.ndarray  # (a * k + b) * k + c -> row of the longest kept ending of the context abc
    size: int  # k, the number of columns
    whole: int  # the first row of a context of three bytes

    @classmethod
    def build(cls, codes: np.ndarray, counts: np.ndarray, pairs: tuple, single: tuple) -> Trie:
        """codes, counts: of kept contexts of three bytes; pairs, single: the same for two bytes and for one (all kept)."""
        codes1, counts1 = single
        seen = np.unique(codes1 & 0xFF)
        context_bytes = np.unique(np.concatenate([seen, codes1 >> 8, [EDGE]]))
        columns = np.full(256, len(context_bytes), np.int64)
        columns[context_bytes.astype(np.int64)] = np.arange(len(context_bytes))
        k = len(context_bytes) + 1

        def matrix(codes, counts):
            contexts, row = np.unique(codes >> 8, return_inverse=True)
            m = np.zeros((len(contexts), k))
            m[row, columns[(codes & 0xFF).astype(np.int64)]] = counts
            return contexts.astype(np.int64), m

        c3, m3 = matrix(codes, counts)
        c2, m2 = matrix(*pairs)
        c1, m1 = matrix(codes1, counts1)
        m0 = m1.sum(0, keepdims=True)
        # Bytes that stand nowhere in training: the context bytes that are never symbols, and all others.
        nowhere = 256 - int((m0[0] > 0).sum())
        last = np.where(m0 > 0, 0.0, 1.0 / max(1, nowhere))  # after escaping from the empty context

        def own(m, after):
            t, d = m.sum(1, keepdims=True), (m > 0).sum(1, keepdims=True)
            return np.where(m > 0, m, d * after) / np.maximum(t + d, 1)

        def escaped(m, parent, up, after):
            """Probabilities in the next shorter context once the bytes of the longer one are excluded."""
            shorter = parent[up]
            new = np.where(m > 0, 0.0, shorter)
            t, d = new.sum(1, keepdims=True), (new > 0).sum(1, keepdims=True)
            # With nothing new there, the escape from it is certain.
            return np.where(d > 0, np.where(shorter > 0, new, d * after[up]) / np.maximum(t + d, 1), after[up])

        up1 = np.zeros(len(c1), np.int64)
        up2 = np.searchsorted(c1, c2 & 0xFF)
        up3 = np.searchsorted(c2, c3 & 0xFFFF)
        e1 = escaped(m1, m0, up1, last)
        e2 = escaped(m2, m1, up2, e1)
        e3 = escaped(m3, m2, up3, e2)
        p = np.concatenate([own(m0, last), own(m1, e1), own(m2, e2), own(m3, e3)])
        rows = np.zeros((k, k, k), np.int32)
        at = lambda c: columns[c]
        rows[:, :, at(c1)] = 1 + np.arange(len(c1))
        rows[:, at(c2 >> 8), at(c2 & 0xFF)] = 1 + len(c1) + np.arange(len(c2))
        rows[at(c3 >> 16), at(c3 >> 8 & 0xFF), at(c3 & 0xFF)] = 1 + len(c1) + len(c2) + np.arange(len(c3))
        rows[:, :, k - 1] = 0  # a context byte never seen
        rows[:, k - 1, :] = rows[k - 1, k - 1, :]
        with np.errstate(divide="ignore"):
            logp = np.log10(p)
        return cls(columns, np.maximum(logp, -99).astype(np.float32), rows.reshape(-1), k, 1 + len(c1) + len(c2))

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """log10 probability of each text, its end included, but for the bytes after contexts that may have been
        counted and aren't kept: their distinct codes, as those of grams(), and how often each stands in the text."""
        if not texts:
            return np.zeros(0), [], []
        edge = b"\xff"
        flat = np.frombuffer(b"".join([edge * 3 + t.lower() for t in texts]) + edge * 3, np.uint8)
        c = self.columns[flat]
        k = self.size
        row = self.rows[(c[:-3] * k + c[1:-2]) * k + c[2:-1]]
        p = self.logp.reshape(-1)[row.astype(np.int64) * k + c[3:]].astype(np.float64)
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        start = np.concatenate([[0], np.cumsum(lengths + 3)[:-1]])
        # A context with a byte seen nowhere was never counted.
        at = np.flatnonzero((row < self.whole) & (c[:-3] < k - 1) & (c[1:-2] < k - 1) & (c[2:-1] < k - 1))
        text = np.searchsorted(start, at, "right") - 1
        inside = at - start[text] <= lengths[text]
        at, text = at[inside], text[inside]
        p[at] = 0
        total = np.concatenate([[0.0], np.cumsum(p)])
        code = text << 32
        for i in range(4):
            code |= flat[at + i].astype(np.int64) << (24 - 8 * i)
        code, times = np.unique(code, return_counts=True)
        ends = np.searchsorted(code >> 32, np.arange(1, len(texts)))
        return total[start + lengths + 1] - total[start], np.split(code & 0xFFFFFFFF, ends), np.split(times, ends)

    def logs(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of codes as those of grams(), each by the longest kept ending of its context."""
        c = [self.columns[codes >> shift & 0xFF] for shift in (24, 16, 8, 0)]
        return self.logp[self.rows[(c[0] * self.size + c[1]) * self.size + c[2]], c[3]].astype(np.float64)


def _emit(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema)], schema=schema)


def count_words(text: bytes, counts: Counter) -> int:
    """Add a text's lower-cased words and its end to `counts`; the bytes that words new there take, about.

    set.difference() would walk all of a Counter for each text, so the text's own words are looked up.
    """
    words = text.lower().split()
    new = sum(len(w) + 150 for w in set(words) if w not in counts)
    counts.update(words)
    counts[b""] += 1
    return new


def word_counts(texts: DataFrame) -> DataFrame:
    """Count of each lower-cased word of column t, one end (the empty word) a text included: w binary, c long.

    Each task sums its words first, in a table that is handed on before it outgrows memory.
    """
    ddl = "w binary, c long"
    schema = arrow_schema(ddl)

    def run(batches):
        counts: Counter = Counter()
        used = 0
        for batch in parts_of(batches):
            for text in batch.column(0).to_pylist():
                used += count_words(text, counts)
                if used > COUNTED:
                    yield _emit(schema, list(counts), list(counts.values()))
                    counts, used = Counter(), 0
        if counts:
            yield _emit(schema, list(counts), list(counts.values()))

    return texts.transform(in_arrow, run, ddl).groupBy("w").agg(F.sum("c").alias("c"))


def gram_counts(texts: DataFrame) -> DataFrame:
    """Count of each code of grams() over column t: g long, c long; each task sums its own first."""
    ddl = "g long, c long"
    schema = arrow_schema(ddl)

    def run(batches):
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            codes = np.concatenate([p[0] for p in parts])
            counts = np.concatenate([p[1] for p in parts])
            o = np.argsort(codes, kind="stable")
            codes, counts = codes[o], counts[o]
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            return codes[first], np.add.reduceat(counts, first)

        for batch in parts_of(batches):
            for texts_ in _chunks(batch.column(0).to_pylist()):
                parts.append(grams(texts_))
                if sum(len(p[0]) for p in parts) > 2_000_000:
                    codes, counts = merged()
                    if len(codes) > 1_000_000:
                        yield _emit(schema, codes.astype(np.int64), counts)
                        parts = []
                    else:
                        parts = [(codes, counts)]
        if parts:
            codes, counts = merged()
            yield _emit(schema, codes.astype(np.int64), counts)

    return texts.transform(in_arrow, run, ddl).groupBy("g").agg(F.sum("c").alias("c"))


def _chunks(texts: list[bytes]):
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= _CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def train(full: DataFrame, max_contexts: int = MAX_CONTEXTS) -> Trie:
    """The trie of all texts whose gram_counts() are `full`.

    What the driver gathers is bounded: at most `max_contexts` contexts of three bytes, which are those with at
    least 1 / max_contexts of all occurrences, and all of two (65,536) and one (256), with 256 bytes at most each.
    code_logs() has the bytes after all other contexts.
    """

    def level(width: int) -> tuple[np.ndarray, np.ndarray]:
        by = _shorter(full, width)
        if width > 2:
            total = full.agg(F.sum("c").alias("n"))
            kept = _contexts(by).join(F.broadcast(total), F.col("t") * max_contexts >= F.col("n")).select("x")
            by = by.join(F.broadcast(kept), F.shiftright("g", 8) == F.col("x"), "left_semi")  # at most max_contexts rows
        t = by.select("g", "c").toArrow()
        g, c = t.column("g").to_numpy().astype(np.int64), t.column("c").to_numpy().astype(np.float64)
        o = np.argsort(g)
        return g[o], c[o]

    return Trie.build(*level(3), level(2), level(1))


def _shorter(full: DataFrame, width: int) -> DataFrame:
    """g, c: the counts of gram_counts() by contexts of `width` bytes."""
    mask = (1 << (8 * (width + 1))) - 1
    return full.groupBy(F.col("g").bitwiseAND(F.lit(mask)).alias("g")).agg(F.sum("c").alias("c"))


def _contexts(by: DataFrame) -> DataFrame:
    """x, t, d: occurrences and distinct bytes after each context of (g, c)."""
    return by.groupBy(F.shiftright("g", 8).alias("x")).agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("d"))


def _fixed(log: Column) -> Column:
    return F.round(log * FIXED).cast("long")


def code_logs(full: DataFrame, asked: DataFrame, trie) -> DataFrame:
    """g, log: log10 probability times FIXED of every code of `full`, and of those of `asked` (g, distinct) that it lacks.

    `trie` is a broadcast of train(full).  A code seen has its share of its context.  Any other is escaped from
    its context of three bytes, if that was seen, to the one of two, without the bytes seen after the former; what
    comes after another escape depends on the context of two alone, so it stands in the trie, beside that escape.
    """
    contexts = _contexts(full)
    seen = full.join(contexts, F.shiftright("g", 8) == F.col("x")).select(
        "g", _fixed(F.log10(F.col("c") / (F.col("t") + F.col("d")))).alias("log")
    )
    by = _shorter(full, 2)
    pair = by.select(F.col("g").alias("g2"), F.col("c").alias("c2"))
    pairs = _contexts(by).toDF("x2", "t2", "d2")
    new = asked.join(full, "g", "left_anti").withColumn("x", F.shiftright("g", 8))
    # Of a context: t occurrences of d bytes, and how often those d follow its last two bytes.
    left = (
        full.withColumn("x", F.shiftright("g", 8))
        .join(new.select("x").distinct(), "x", "left_semi")
        .join(pair, F.col("g").bitwiseAND(F.lit(0xFFFFFF)) == F.col("g2"))
        .groupBy("x")
        .agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("d"), F.sum("c2").alias("s"))
    )
    new = (
        new.join(left, "x", "left")
        .join(pair, F.col("g").bitwiseAND(F.lit(0xFFFFFF)) == F.col("g2"), "left")
        .join(pairs, F.col("x").bitwiseAND(F.lit(0xFFFF)) == F.col("x2"), "left")
    )
    ddl = "g long, t long, d long, s long, c2 long, t2 long, d2 long, p double"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            p = trie.value.logs(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], schema=schema)

    new = new.select("g", "t", "d", "s", "c2", "t2", "d2").transform(in_arrow, run, ddl)
    t2, d2 = F.col("t2") - F.col("s"), F.col("d2") - F.col("d")
    further = F.when(
        F.col("c2").isNull(),
        # The trie's escape from two bytes gives way to the one without the bytes excluded; with none left it is certain.
        F.col("p") + F.log10((F.col("t2") + F.col("d2")) / F.col("d2")) + F.when(d2 > 0, F.log10(d2 / (t2 + d2))).otherwise(0.0),
    ).otherwise(F.log10(F.col("c2") / (t2 + d2)))
    log = F.when(F.col("t").isNull(), F.col("p")).otherwise(F.log10(F.col("d") / (F.col("t") + F.col("d"))) + further)
    return seen.union(new.select("g", _fixed(log).alias("log")))


def score(
    docs: DataFrame,
    train_on: Column,
    keep: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
    max_contexts: int = MAX_CONTEXTS,
    max_common: int = MAX_COMMON,
) -> DataFrame:
    """Score every whole text by models of those rows of `docs` for which `train_on` holds.

    Returns `keep`, n_tokens (words and one end), n_known (tokens with a count), train_tokens, base_score (add-one
    unigram, log10) and score (PPM, log10).  A null text counts as empty: its one token is the end.  Repeated rows
    are scored each and count each.  Without training rows every token is unknown and both models are uniform; an empty
    table gives an empty result.  Very long texts are scored whole, by rows of fixed size for each of their distinct codes.
    A kept column that is called like an output comes out with an underscore before its name; others are not read.

    The counts of words that make up at least 1 / max_common of the tokens are broadcast; all other words of a
    text go to their counts in a join, once a text.  So do bytes after contexts that train() doesn't keep; neither
    limit changes a result.
    """
    spark = docs.sparkSession
    train_texts = docs.filter(train_on).select(utf8(text_col).alias("t"))
    counts = staged(word_counts(train_texts), "words")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = totals["n"], totals["v"]
    # At most max_common words of COMMON_BYTES bytes, and the end.
    common = counts.filter(((F.col("c") * max_common >= n) & (F.length("w") <= COMMON_BYTES)) | (F.length("w") == 0)).toArrow()
    table_ = dict(zip(common.column("w").to_pylist(), common.column("c").to_pylist()))
    sent_common = spark.sparkContext.broadcast(table_)
    full = staged(gram_counts(train_texts), "grams")
    sent_trie = spark.sparkContext.broadcast(train(full, max_contexts))

    source = docs.select(
        F.monotonically_increasing_id().alias("row"),
        *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)],
        F.coalesce(train_on, F.lit(False)).alias("trained"),
        utf8(text_col).alias("t"),
    )
    kinds = [f"k{i} {source.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))]
    ddl = ", ".join(
        [
            "row long",
            *kinds,
            "trained boolean, n_tokens long, known long, part long, score double, w array<binary>, m array<int>",
            "codes array<long>, times array<int>",
        ]
    )
    schema = arrow_schema(ddl)

    def run(batches):
        trie = sent_trie.value
        logs = {w: round(float(np.log10(c + 1)) * FIXED) for w, c in sent_common.value.items()}
        end = logs.get(b"")
        for batch in parts_of(batches):
            cols = [c.to_pylist() for c in batch.columns]
            for lo, hi in _spans([len(t) for t in cols[-1]]):
                texts = cols[-1][lo:hi]
                scores, codes, code_times = trie.score(texts)
                out = []
                for text in texts:
                    words = text.lower().split()
                    known, part, rare, times = int(end is not None), end or 0, [], []
                    for w, k in Counter(words).items():
                        log = logs.get(w)
                        if log is None:
                            rare.append(w)
                            times.append(k)
                        else:
                            known += k
                            part += k * log
                    out.append((len(words) + 1, known, part, rare, times))
                a = list(zip(*out))
                yield _emit(schema, *[c[lo:hi] for c in cols[:-1]], a[0], a[1], a[2], scores, a[3], a[4], codes, code_times)

    scored = staged(source.transform(in_arrow, run, ddl), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("w", "m")).alias("x")).select("row", "x.w", "x.m")
    log = _fixed(F.log10(F.col("c") + 1))
    found = (
        rare.join(counts, "w")
        .groupBy("row")
        .agg(F.sum("m").alias("more_known"), F.sum(F.col("m") * log).alias("more"))
    )
    # Training texts hold no code that wasn't counted.
    asked = scored.filter(~F.col("trained")).select(F.explode("codes").alias("g")).distinct()
    by_code = staged(code_logs(full, asked, sent_trie), "codes")
    coded = (
        scored.select("row", F.explode(F.arrays_zip("codes", "times")).alias("x"))
        .select("row", F.col("x.codes").alias("g"), "x.times")
        .join(by_code, "g")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.col("log")).alias("coded"))
    )
    known = F.col("known") + F.coalesce("more_known", F.lit(0))
    logs = (F.col("part") + F.coalesce("more", F.lit(0))) / F.lit(float(FIXED))
    scored = scored.drop("trained", "w", "m", "codes", "times")
    names = kept_names(keep, ("n_tokens", "n_known", "train_tokens", "base_score", "score"))
    return scored.join(found, "row", "left").join(coded, "row", "left").select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(names)],
        "n_tokens",
        known.alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        (F.col("score") + F.coalesce("coded", F.lit(0)) / F.lit(float(FIXED))).alias("score"),
    )


def _spans(sizes: list[int]):
    lo = size = 0
    for i, s in enumerate(sizes):
        size += s
        if size >= _CHUNK:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(sizes):
        yield lo, len(sizes)


def held_out() -> Column:
    return F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, token counts, base score and score of all documents, learnt from those that are not held out."""
    return score(texts_of(spark, sf_dir), ~held_out()).select(
        "doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
