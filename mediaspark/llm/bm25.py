"""Exact top-k search by BM25 over inverted-index shards, many queries at once.

Documents are dealt into shards of about equal numbers of postings, and each shard's inverted index is written once: for
each term its postings in document order, for each document its terms.  Documents of a shard are ordered by their
most telling frequent word and by length, so that neighbours have much alike.
Weights of query terms come from global statistics, so the scores of all shards compare, and the best k of a
query are the best of the shards' best k.

A query first meets its home shards, as those are built; its k-th best score there is a threshold for all others.  Then
blocks of queries of bounded size are sent to the tasks that read the shards: work is dealt in cells of one shard and one
block, whose size does not grow with the corpus, and the index is read but never shuffled.  A task raises its thresholds from
shard to shard.

Within a shard the scores of all documents are added up in single precision, for many queries at once.  Alike documents stand
side by side, in regions, and so do alike queries: a term that many of the queries and many documents of a region have goes into
a product of matrices, where a posting costs a hundredth of what it costs alone.  The other postings are added one by one.
Documents whose sums reach the threshold, which errs on the low side, are scored in full, in double precision, so the result is
that of scoring every document.

Words are told apart by 64-bit fingerprints.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import arrow_schema, discard, in_arrow, parts_of, staged, texts_of, utf8

K1, B = 1.2, 0.75
#: Postings in a shard, about.
SHARD_POSTINGS = 2_000_000
#: Shards that a query meets as they are built.
HOMES = 4
#: Frequent words of a shard, or of a block of queries, by which its documents or queries are ordered.
TELLING = 64
#: Postings that are worked on at once; arrays of all of a shard's are few.
STEP = 1 << 19
#: Postings in a region of a shard, about, and documents at most.
REGION_POSTINGS, REGION_DOCS = 500_000, 8_192
#: A term in at least one of so many documents of a region, and in MIN_DENSE, stands as a full row there.
DENSE, MIN_DENSE = 32, 4
#: Queries whose scores are added up at once, and whose postings are (a part of these); scores in a region's full rows, at most.
QUERIES, GROUP, CELLS = 128, 32, 1 << 20
#: Additions in a product of matrices that take as long as that of one posting, about.
PRODUCT = 192
#: Postings that are added one by one at once, about.
PRODUCTS = 1 << 19
NUMBERS = np.arange(2 * PRODUCTS)
#: Pairs of a query and a document that are scored in full at once, about.
PAIRS = 1 << 18
#: Queries, and words of theirs, that are sent to the tasks at once, about: 20 bytes a word.
QUERY_BLOCK, QUERY_WORDS = 8_192, 2_000_000
#: Tasks that build the index, at most; each builds its shards one after another.
TASKS = 10_000
#: Words that a task counts, and bytes of text that it takes them from, before it hands its counts on.
WORDS, COUNTED = 250_000, 32 << 20
#: Bytes of a packed index in one row, and rows in a batch of them.
PART, PART_ROWS = 64 << 10, 16
#: What sums in single precision may be off, as a part of them, and the least of them that counts.
SLACK, TINY = 1e-4, 1e-30


#: The fingerprint of a word.
FINGERPRINT = xxhash.xxh3_64_intdigest


def counted(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of a text's words, lower-cased (A-Z), in order, and how often each stands in it."""
    counts = Counter(text.lower().split())
    h = np.fromiter(map(FINGERPRINT, counts), np.uint64, len(counts))
    c = np.fromiter(counts.values(), np.int32, len(counts))
    order = np.argsort(h)
    return h[order], c[order]


#: What pack() keeps of an index.
ARRAYS = ("vocabulary", "doc_freq", "doc_term", "doc_start", "lengths", "edge", "post_doc", "post_freq")


class Shard:
    """The index of one shard: add() documents, then seal() or give pack() to a later load(); then search()."""

    def __init__(self, mean_length: float):
        self.mean = max(mean_length, 1e-9)
        self.ids: list = []
        self.sizes: list[int] = []
        self.words, self.freqs = np.empty(1 << 20, np.uint64), np.empty(1 << 20, np.int32)
        self.used = 0

    def add(self, doc_id, words: np.ndarray, freqs: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.sizes.append(len(words))
        end = self.used + len(words)
        if end > len(self.words):
            room = max(end, len(self.words) * 3 // 2) - self.used
            self.words = np.concatenate([self.words[: self.used], np.empty(room, np.uint64)])
            self.freqs = np.concatenate([self.freqs[: self.used], np.empty(room, np.int32)])
        self.words[self.used : end], self.freqs[self.used : end] = words, freqs
        self.used = end

    def seal(self) -> Shard:
        n = len(self.ids)
        sizes = np.array(self.sizes, np.int64)
        start = np.concatenate([[0], np.cumsum(sizes)])
        words, freq = self.words[: self.used], self.freqs[: self.used]
        self.words = self.freqs = None
        lengths = np.fromiter((freq[start[i] : start[i + 1]].sum() for i in range(n)), np.int64, n)
        # Arrays of all postings are let go as soon as they have served; the largest are made in steps.
        self.vocabulary, df = np.unique(words, return_counts=True)
        term = np.empty(len(words), np.int32)
        for lo in range(0, len(words), STEP):
            term[lo : lo + STEP] = np.searchsorted(self.vocabulary, words[lo : lo + STEP])
        del words
        freq = freq.astype(np.uint16) if freq.max(initial=0) < 1 << 16 else freq.copy()
        # The frequent word of which a document has most for its length and the word's frequency tells what it is like.
        telling = np.full(len(df), -1)
        best = np.argsort(-df, kind="stable")[:TELLING]
        telling[best] = np.arange(len(best))
        kind = np.full(n, -1)
        for i in range(n):
            t, f = term[start[i] : start[i + 1]], freq[start[i] : start[i + 1]]
            own = telling[t] >= 0
            if own.any():
                kind[i] = telling[t[own]][np.argmax(f[own] / df[t[own]])]
        order = np.lexsort((lengths, kind))
        sizes = sizes[order]
        self.doc_start = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(start[order] - self.doc_start[:-1], sizes)
        at += np.arange(len(at))
        self.doc_term, self.doc_freq = term[at], freq[at]
        del at, term, freq
        self.ids = [self.ids[i] for i in order]
        self.lengths = lengths[order]
        # Regions of about as many postings each; their postings stand together, by term and document.
        regions = max(1, -(-len(self.doc_term) // REGION_POSTINGS))
        self.edge = np.unique(np.searchsorted(self.doc_start, np.linspace(0, self.doc_start[-1], regions + 1)[1:-1]))
        self.edge = np.unique(np.concatenate([[0], self.edge, np.arange(0, n, REGION_DOCS), [n]]))
        self.post_doc, self.post_freq = np.empty(len(self.doc_term), np.int32), np.empty_like(self.doc_freq)
        for lo, hi in zip(self.edge[:-1].tolist(), self.edge[1:].tolist()):
            a, b = self.doc_start[lo], self.doc_start[hi]
            by_term = np.argsort(self.doc_term[a:b], kind="stable")
            self.post_doc[a:b] = np.repeat(np.arange(hi - lo, dtype=np.int32), sizes[lo:hi])[by_term]
            self.post_freq[a:b] = self.doc_freq[a:b][by_term]
        return self._prepare()

    def pack(self) -> bytes:
        """The index as bytes: the length of a head, the head, then each array where a multiple of 8 bytes begins."""
        arrays = [np.ascontiguousarray(getattr(self, x)) for x in ARRAYS]
        head = pickle.dumps((self.mean, self.ids, [(a.dtype.str, len(a)) for a in arrays]))
        out = [len(head).to_bytes(8, "little"), head, bytes(-len(head) % 8)]
        for a in arrays:
            out += [memoryview(a).cast("B") if len(a) else b"", bytes(-a.nbytes % 8)]
        return b"".join(out)

    @classmethod
    def load(cls, data: bytes | bytearray) -> Shard:
        """The index that pack() gave; its arrays stay views of `data`."""
        at = 8 + int.from_bytes(data[:8], "little")
        mean, ids, arrays = pickle.loads(memoryview(data)[8:at])
        shard = cls(mean)
        shard.ids = ids
        for name, (kind, n) in zip(ARRAYS, arrays):
            at += -at % 8
            setattr(shard, name, np.frombuffer(data, kind, n, at))
            at += getattr(shard, name).nbytes
        return shard._prepare()

    def _prepare(self) -> Shard:
        self.norm = K1 * (1 - B + B * self.lengths / self.mean)
        self.part = np.zeros(len(self.vocabulary) + 1)
        return self

    def search(self, block: Block, floors: np.ndarray, k: int, chosen: np.ndarray | None = None) -> Iterator[tuple[int, list[tuple]]]:
        """For queries of a block (the chosen ones, if given) their numbers and the best k (doc id, score) with a score over 0, unless
        it is under the query's floor: such may be left out.  A query may come more than once, or not at all if it finds nothing.

        Equal scores rank by the lesser id.
        """
        if not len(self.vocabulary) or k < 1:
            return
        # The words of all queries are looked up once, in order; those that the shard lacks get the number after the last.
        place = np.minimum(np.searchsorted(self.vocabulary, block.vocabulary), len(self.vocabulary) - 1).astype(np.int32)
        place[self.vocabulary[place] != block.vocabulary] = len(self.vocabulary)
        term = place.take(block.word)
        word, weight, query, first = block.by_word()
        terms = place.take(word)
        # A sum under this is none of the best k: under the floor, or under the k-th best sum of a region.
        least = np.maximum(floors * (1 - SLACK), TINY).astype(np.float32)
        hits, pairs = [], 0
        for lo, hi in zip(self.edge[:-1].tolist(), self.edge[1:].tolist()):
            region = Region(self, lo, hi)
            for q, a, b in zip(range(0, len(block.q), QUERIES), first[:-1].tolist(), first[1:].tolist()):
                n = min(QUERIES, len(block.q) - q)
                size = region.size.take(terms[a:b])
                if chosen is not None and not chosen[q : q + n].all():
                    size *= chosen[q : q + n].take(query[a:b])
                known = np.flatnonzero(size)
                if not len(known):
                    continue
                size = size.take(known)
                known += a
                sums = region.sums(terms.take(known), size, weight.take(known), query.take(known), n)
                low = least[q : q + n]
                over = sums >= low[:, None]
                found = np.count_nonzero(over, axis=1)
                for i in np.flatnonzero(found > k).tolist():
                    low[i] = max(low[i], np.partition(sums[i], hi - lo - k)[hi - lo - k] * (1 - 2 * SLACK))
                    over[i] = sums[i] >= low[i]
                at = np.flatnonzero(over)
                found, docs = np.divmod(at, hi - lo)
                hits.append((found + q, docs + lo, sums.reshape(-1).take(at)))
                pairs += len(at)
                if pairs > PAIRS:
                    yield from self._best(hits, block, term, least, k)
                    hits, pairs = [], 0
        if hits:
            yield from self._best(hits, block, term, least, k)

    def _exact(self, query: np.ndarray, doc: np.ndarray, block: Block, term: np.ndarray) -> np.ndarray:
        """Full scores of pairs of a query and a document; terms are added in the order of their fingerprints.

        A document that many queries find is read once.
        """
        out = np.zeros(len(doc))
        order = np.argsort(doc, kind="stable")
        found, first = np.unique(doc[order], return_index=True)
        for d, pairs in zip(found.tolist(), np.split(order, first[1:])):
            lo, hi = self.doc_start[d], self.doc_start[d + 1]
            terms, freq = self.doc_term[lo:hi], self.doc_freq[lo:hi]
            self.part[terms] = freq / (freq + self.norm[d])
            for at in range(0, len(pairs), 256):
                some = pairs[at : at + 256]
                start = block.first[query[some]]
                size = block.first[query[some] + 1] - start
                words = runs(start, size)
                gain = self.part.take(term.take(words), mode="clip")  # the last, always 0, for words that the shard lacks
                gain *= block.weight.take(words, mode="clip")
                out[some] = np.bincount(np.arange(len(some)).repeat(size), gain, minlength=len(some))
            self.part[terms] = 0
        return out

    def _best(self, hits: list[tuple], block: Block, term: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple]]]:
        """The best k of each query among pairs (queries, documents, sums), scored in full; `least` rises to what its sums show."""
        query, doc, sums = (np.concatenate(x) for x in zip(*hits))
        order = np.lexsort((-sums, query))
        query, doc, sums = query[order], doc[order], sums[order]
        found, first = np.unique(query, return_index=True)
        last = np.append(first[1:], len(query))
        full = last - first >= k
        least[found[full]] = np.maximum(least[found[full]], sums[first[full] + k - 1] * np.float32(1 - 2 * SLACK))
        good = sums >= least[query]
        query, doc = query[good], doc[good]
        scores = self._exact(query, doc, block, term)
        found, first = np.unique(query, return_index=True)
        for i, d, s in zip(found.tolist(), np.split(doc, first[1:]), np.split(scores, first[1:])):
            rows = best_of([(self.ids[x], round(y, 6)) for x, y in zip(d.tolist(), s.tolist()) if y > 0], k)
            if rows:
                yield i, rows


def pieces(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Where each PART bytes begin, and a copy of them: pyarrow never lets go of a memoryview, nor so of all that it is a view of."""
    for lo in range(0, len(data), PART):
        yield lo, data[lo : lo + PART]


class Region:
    """Neighbours among a shard's documents, from `lo` to before `hi`: their postings, and terms in many of them as full rows."""

    def __init__(self, shard: Shard, lo: int, hi: int):
        a, b = shard.doc_start[lo], shard.doc_start[hi]
        self.n, v = hi - lo, len(shard.vocabulary)
        self.size = np.bincount(shard.doc_term[a:b], minlength=v + 1).astype(np.int32)  # the last is 0
        self.start = np.cumsum(self.size, dtype=np.int32) - self.size
        # A posting's document and its part of a score stand in one number, so that one reading gets both.
        self.postings = np.empty(b - a, np.int64)
        doc, part = self._halves(self.postings)
        doc[:] = shard.post_doc[a:b]
        freq = shard.post_freq[a:b]
        part[:] = freq / (freq + shard.norm[lo:hi].take(shard.post_doc[a:b]))
        often = np.flatnonzero(self.size * DENSE >= max(self.n, DENSE * MIN_DENSE))
        often = often[np.argsort(-self.size[often], kind="stable")[: CELLS // self.n + 1]]
        self.row = np.full(v + 1, -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.row_size = self.size[often].astype(np.int64)
        self.dense = np.zeros((len(often), self.n), np.float32)
        at = runs(self.start[often].astype(np.int64), self.row_size)
        doc, part = self._halves(self.postings.take(at))
        self.dense.reshape(-1)[doc + (np.arange(len(often)) * self.n).repeat(self.row_size)] = part

    @staticmethod
    def _halves(postings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return postings.view(np.int32)[::2], postings.view(np.float32)[1::2]

    def sums(self, term: np.ndarray, size: np.ndarray, weight: np.ndarray, query: np.ndarray, n_queries: int) -> np.ndarray:
        """For each query and document the sum over the queries' terms, in single precision; each GROUP queries' terms are in order.

        Terms that many of the queries and many documents have go into a product of matrices; postings of others are added one by one.
        """
        row = self.row.take(term)
        asked = np.bincount(row + 1, minlength=len(self.dense) + 1)[1:]
        rows = np.flatnonzero(asked * self.row_size * PRODUCT > n_queries * self.n)
        if len(rows):
            place = np.full(len(self.dense) + 1, -1)  # the last for terms without a row
            place[rows] = np.arange(len(rows))
            place = place.take(row, mode="wrap")
            full = np.flatnonzero(place >= 0)
            matrix = np.zeros((n_queries, len(rows)), np.float32)
            matrix[query[full], place[full]] = weight[full]
            sums = matrix @ self.dense[rows]
            rest = np.flatnonzero(place < 0)
            term, size, weight, query = (x.take(rest) for x in (term, size, weight, query))
        else:
            sums = np.zeros((n_queries, self.n), np.float32)
        start, first = self.start.take(term), np.searchsorted(query // GROUP, np.arange(-(-n_queries // GROUP) + 1))
        for g, lo, end in zip(range(0, n_queries, GROUP), first[:-1].tolist(), first[1:].tolist()):
            some = sums[g : g + GROUP]
            taken = np.cumsum(size[lo:end], dtype=np.int64)
            while lo < end:
                hi = end if taken[-1] <= PRODUCTS else lo + max(1, int(np.searchsorted(taken, PRODUCTS, "right")))
                s = size[lo:hi]
                doc, part = self._halves(self.postings.take(runs(start[lo:hi], s), mode="clip"))  # clip: without a test of each
                cell = ((query[lo:hi] - np.int64(g)) * self.n).repeat(s)
                cell += doc
                gain = weight[lo:hi].repeat(s)
                gain *= part
                some += np.bincount(cell, gain, minlength=some.size).reshape(some.shape)
                taken = taken[hi - lo :] - taken[hi - lo - 1]
                lo = hi
        return sums


def best_of(rows: list[tuple], k: int) -> list[tuple]:
    """The best k of (doc id, score); equal scores rank by the lesser id, null last."""
    return sorted(rows, key=lambda x: (-x[1], x[0] is None, x[0]))[:k]


def gather(found: Iterable[tuple[int, list[tuple]]], best: dict[int, list[tuple]], floors: np.ndarray, k: int) -> None:
    """Keep the best k that each query has found so far, and raise its floor to the last of them."""
    for i, rows in found:
        best[i] = best_of(best[i] + rows, k) if i in best else rows
        if len(best[i]) == k:
            floors[i] = max(floors[i], best[i][-1][1])


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one run after the other."""
    ends = np.cumsum(size, dtype=np.int64)
    at = (start - ends + size).repeat(size)
    at += NUMBERS[: len(at)] if len(at) <= len(NUMBERS) else np.arange(len(at))
    return at


class Block:
    """Queries that are searched together: of (number, home, words, weights, floor), alike ones side by side.

    q, home and floor by query; first: where its words begin.  vocabulary: the fingerprints of all their words in order; word and
    weight: for each word of a query its place there and its weight.
    """

    def __init__(self, queries: Iterable[tuple]):
        rows = list(queries)
        words = [np.frombuffer(x[2], np.uint64) for x in rows]
        size = np.fromiter(map(len, words), np.int64, len(rows))
        words = np.concatenate([*words, np.empty(0, np.uint64)])
        self.vocabulary, word = np.unique(words, return_inverse=True)
        del words
        word, weight = word.astype(np.int32), np.concatenate([np.frombuffer(x[3], np.float64) for x in rows] or [np.empty(0)])
        # The frequent word of which a query has most for the word's frequency tells what it is like.
        df = np.bincount(word, minlength=len(self.vocabulary))
        telling = np.full(len(df), -1)
        best = np.argsort(-df, kind="stable")[:TELLING]
        telling[best] = np.arange(len(best))
        kind, first = np.full(len(rows), -1), np.concatenate([[0], np.cumsum(size)])
        for i in range(len(rows)):
            t, w = word[first[i] : first[i + 1]], weight[first[i] : first[i + 1]]
            own = telling[t] >= 0
            if own.any():
                kind[i] = telling[t[own]][np.argmax(w[own] / df[t[own]])]
        order = np.lexsort((size, kind))
        at = runs(first[order], size[order])
        self.word, self.weight = word[at], weight[at]
        self.first = np.concatenate([[0], np.cumsum(size[order])])
        self.q = np.array([rows[i][0] for i in order], np.int64)
        self.home = np.array([rows[i][1] for i in order], np.int64)
        self.floor = np.array([rows[i][4] for i in order], np.float64)
        self._by_word: tuple | None = None

    def by_word(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words of each GROUP queries in order, their weights and queries (from 0 in each QUERIES), and where each QUERIES begin:
        made where it is asked for, as it need not be sent."""
        if self._by_word is None:
            word, weight = np.empty_like(self.word), np.empty(len(self.word), np.float32)
            query, first = np.empty(len(self.word), np.uint8), np.append(self.first[:-1:QUERIES], self.first[-1])
            for q, lo, hi in zip(range(0, len(self.q), QUERIES), first[:-1].tolist(), first[1:].tolist()):
                size = np.diff(self.first[q : q + QUERIES + 1])
                of = np.arange(len(size), dtype=np.uint8).repeat(size)
                order = np.lexsort((self.word[lo:hi], of // GROUP))
                word[lo:hi], weight[lo:hi], query[lo:hi] = self.word[lo:hi].take(order), self.weight[lo:hi].take(order), of.take(order)
            self._by_word = word, weight, query, first
        return self._by_word


def document_frequencies(texts: DataFrame) -> DataFrame:
    """h long, df long over column t: documents that hold the word with this fingerprint; each task counts its own first.

    A row with a null h counts the documents as df, and its n_words (null elsewhere) their words.
    """
    ddl = "h long, df long, n_words long"
    schema = arrow_schema(ddl)

    def run(batches):
        df, held, n, words = Counter(), 0, 0, 0

        def out(hs, counts, n_words):
            cols = [pa.array(c, pa.int64()) for c in (hs, counts, n_words)]
            return pa.RecordBatch.from_arrays(cols, schema=schema)

        def all_out():
            hs = np.fromiter(map(FINGERPRINT, df), np.uint64, len(df)).view(np.int64)
            return out(hs, np.fromiter(df.values(), np.int64, len(df)), [None] * len(df))

        for batch in parts_of(batches):
            for text in batch.column(0).to_pylist():
                w = text.lower().split()
                words += len(w)
                n += 1
                df.update(set(w))
                held += len(text)
                if len(df) > WORDS or held > COUNTED:
                    yield all_out()
                    df, held = Counter(), 0
        if df:
            yield all_out()
        if n:
            yield out([None], [n], [words])

    return texts.transform(in_arrow, run, ddl).groupBy("h").agg(F.sum("df").alias("df"), F.sum("n_words").alias("n_words"))


def _asked(queries: DataFrame, stats: DataFrame, n: int, shards: int) -> DataFrame:
    """q, home, n_words, words and weights (fingerprints and weights as bytes) of queries (q, t)."""
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return (
        queries.transform(in_arrow, _query_words, "q long, h long, c long")
        .join(stats.filter("h is not null").select("h", "df"), "h")
        .groupBy("q")
        .agg(F.collect_list(F.struct("h", (F.col("c") * idf).alias("x"))).alias("m"))  # one text's words
        .select("q", F.col("m.h").alias("h"), F.col("m.x").alias("x"))
        .transform(in_arrow, _pack, "q long, n_words long, words binary, weights binary")
        .withColumn("home", F.pmod(F.xxhash64("q", F.lit(1)), F.lit(shards)).cast("int"))
    )


def top_k(
    docs: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_postings: int = SHARD_POSTINGS,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """The k best documents for each row of `docs` that `is_query` holds for: query_id, rank, doc_id, score.

    A query is the whole text of its row: each distinct word weighs its count times its idf,
    log(1 + (N - df + 0.5) / (df + 0.5)).  Every row is searched, the query's own included.  Equal scores (to six
    decimals) rank by the lesser id.  A null text is empty: as a document never found, as a query without results; a
    null `is_query` is no query.  Repeated rows are documents each; rows with an equal query id are one query each and rank
    apart.  An empty table gives an empty result.  Very long texts are indexed and asked whole.  Ids must be whole numbers, others
    raise TypeError; a null id is found as null.  Other columns are not read, so their names don't matter.

    Queries times documents is quadratic, and so are the cells of one shard and one block of queries; each cell reads one
    index of about `shard_postings` postings and `query_block` queries, which alone are sent to all tasks at once.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    if kind.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError("ids must be whole numbers")
    text = utf8(text_col).alias("t")
    stats = staged(document_frequencies(docs.select(text)), "frequencies")
    whole = stats.filter("h is null").first()
    n = whole["df"] if whole else 0
    mean = whole["n_words"] / n if n else 0.0
    postings = stats.filter("h is not null").agg(F.sum("df")).first()[0] or 0
    shards = max(1, -(-postings // shard_postings))
    queries = staged(
        docs.filter(is_query).select(F.monotonically_increasing_id().alias("q"), F.col(id_col).alias("query_id"), text), "queries"
    )
    asked = staged(_asked(queries.select("q", "t"), stats, n, shards), "asked")
    discard(stats)
    # A file a shard, of one row group, so that one task reads all of it.
    index = staged(_index(docs.select(F.col(id_col).cast("long").alias("id"), text), asked, k, mean, shards), "index", "shard", PART_ROWS)
    # Told by its size: to ask whether data is null would read the packed index, here and whenever the result is evaluated.
    at_home = index.filter("size = 0").select(F.explode(F.arrays_zip("q", "d", "s")).alias("x")).select("x.q", F.col("x.d").alias("doc_id"), F.col("x.s").alias("score"))
    found = [at_home]
    if shards > HOMES:
        scores = F.sort_array(F.collect_list("score"), asc=False)  # k of each home at most
        floors = at_home.groupBy("q").agg(F.get(scores, F.lit(k - 1)).alias("floor"))
        size = asked.agg(F.count(F.lit(1)).alias("q"), F.sum("n_words").alias("w")).first()
        blocks = max(-(-size["q"] // query_block), -(-(size["w"] or 0) // QUERY_WORDS))
        dealt = staged(
            asked.join(floors, "q", "left")
            .withColumn("floor", F.coalesce("floor", F.lit(0.0)))
            .withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"))
            .repartition("block"),
            "dealt",
        )
        for b in range(blocks):
            block = dealt.filter(F.col("block") == b).select("q", "home", "words", "weights", "floor").toArrow()
            sent = spark.sparkContext.broadcast(Block(zip(*[c.to_pylist() for c in block.columns])))
            found.append(staged(_search_block(index, sent, k, shards), "found", rows=PART_ROWS))
            sent.destroy()
        discard(dealt)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(queries.select("q", "query_id"), "q").select("query_id", "rank", "doc_id", "score")


def _index(docs: DataFrame, asked: DataFrame, k: int, mean: float, shards: int) -> DataFrame:
    """For each shard rows with the parts of its packed index (data, which begins at byte `place` of `size`), and one of size 0 with
    q, d, s: what its home queries find there."""
    indexed = docs.select(
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"),
        F.lit(0).alias("kind"), "id", "t", F.lit(None).cast("binary").alias("weights"),
    )
    homes = F.explode(F.sequence(F.lit(0), F.lit(min(HOMES, shards) - 1)))
    at_home = asked.select("*", homes.alias("more")).select(
        F.pmod(F.col("home") + F.col("more"), F.lit(shards)).cast("int").alias("shard"),
        F.lit(1).alias("kind"), F.col("q").alias("id"), F.col("words").alias("t"), "weights",
    )
    ddl = "shard int, size long, place long, data binary, q array<long>, d array<long>, s array<double>"
    schema = arrow_schema(ddl)

    def run(batches):
        shard, number, queries = None, None, []

        def row(*cells):
            return pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip(cells, schema)], schema=schema)

        def out():
            shard.seal()
            block = Block(queries)
            best: dict[int, list[tuple]] = {}
            gather(shard.search(block, block.floor, k), best, block.floor, k)
            flat = [(int(block.q[i]), d, s) for i, rows in best.items() for d, s in rows]
            yield row(number, 0, 0, None, *[[x[i] for x in flat] for i in range(3)])
            data = shard.pack()
            shard.__dict__.clear()  # the packed index alone is needed from here
            for place, part in pieces(data):
                yield row(number, len(data), place, part, None, None, None)

        for batch in parts_of(batches):
            for s, what, i, t, weights in zip(*[c.to_pylist() for c in batch.columns]):
                if s != number:
                    if shard is not None:
                        yield from out()
                    shard, number, queries = Shard(mean), s, []
                if what == 0:
                    shard.add(i, *counted(t))
                else:
                    queries.append((i, s, t, weights, 0.0))
        if shard is not None:
            yield from out()

    tasks = min(shards, TASKS)
    return (
        indexed.union(at_home)
        .repartitionById(tasks, (F.col("shard") % tasks).cast("int"))  # the same number of shards for each task
        .sortWithinPartitions("shard", "kind")
        .transform(in_arrow, run, ddl)
    )


def _search_block(index: DataFrame, sent, k: int, shards: int) -> DataFrame:
    """q, doc_id, score: what a block of queries finds in all shards but their homes, not under their floors; the best k of a task."""
    ddl = "q long, doc_id long, score double"
    schema = arrow_schema(ddl)

    def run(batches):
        whole, read, own = None, 0, None
        block, best = sent.value, {}
        floors = block.floor.copy()
        for batch in batches:
            for number, size, place, data in zip(*[batch.column(i).to_pylist() for i in range(3)], batch.column(3)):
                if whole is None:
                    whole, read, own = bytearray(size), 0, number
                if number != own:
                    raise RuntimeError("a shard was read in part")
                part = data.as_buffer()
                whole[place : place + part.size] = part
                read += part.size
                if read < size:
                    continue
                shard = Shard.load(whole)
                whole = None
                gather(shard.search(block, floors, k, (number - block.home) % shards >= HOMES), best, floors, k)
                del shard
        if whole is not None:
            raise RuntimeError("a shard was read in part")
        if best:
            flat = [(int(block.q[i]), d, s) for i, rows in best.items() for d, s in rows]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*flat), schema)], schema=schema)

    return index.filter("size > 0").select("shard", "size", "place", "data").transform(in_arrow, run, ddl)


def _query_words(batches):
    for batch in parts_of(batches):
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            h, c = counted(t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(h), i, np.int64)), pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["q", "h", "c"]
            )


def _pack(batches):
    """Fingerprints in order and weights as bytes: a query crosses to its home and to a block in little room."""
    for batch in batches:
        q, words, weights = (c.to_pylist() for c in batch.columns)
        h = [np.array(x, np.int64).view(np.uint64) for x in words]
        order = [np.argsort(x) for x in h]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(q, pa.int64()),
                pa.array([len(x) for x in h], pa.int64()),
                pa.array([x[o].tobytes() for x, o in zip(h, order)], pa.binary()),
                pa.array([np.array(x, np.float64)[o].tobytes() for x, o in zip(weights, order)], pa.binary()),
            ],
            names=["q", "n_words", "words", "weights"],
        )


def op8_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, doc_id and score: the ten best documents for each whose id is divisible by 50."""
    return top_k(texts_of(spark, sf_dir), F.col("doc_id") % 50 == 0)
