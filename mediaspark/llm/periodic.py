"""Periodic runs of words within each text, by block matching.

A run is a stretch of words with smallest period q, of max(12, 2 q) words or more, that no neighbouring word extends.

Its words pair up at distance q over at least m = max(q, 12 - q) neighbouring positions.  Of blocks of L words that start
at multiples of L, one lies whole within any 2 L - 1 positions; so with L the largest power of two with 2 L - 1 <= m, an aligned
block of the run occurs again q words on.  At each scale L the aligned blocks of a text are the keys, integer sequences, of an
Aho-Corasick automaton, the text is searched for them all at once, and an occurrence counts as a seed if its distance d from
its block belongs to the scale, 2 L - 1 <= d <= 4 L - 2 (at L = 4 also the shorter ones; at L = 2 only 6).  A seed is extended to both
sides word by word, exactly.  An integer stands for a word at first and for L / 4 words from L = 8 on, so that keys have four letters at most
and neither the automaton nor its failure links grow with L.

Two exact rules keep this near n log n.  A block is no key if one of its four-word sequences stands once in the text.  A seed
within a known run whose period divides d would give that run again: smaller periods come first, so the run is known by then.
"""

from __future__ import annotations

import zlib
from itertools import chain

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, texts_of, utf8

#: Words of a run, at least, however short its period.
LEAST = 12
#: Words whose blocks are in one automaton, or one block if that is longer.
SEGMENT = 1 << 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _repeated(ids: np.ndarray) -> np.ndarray:
    """For each position but the last three, whether its four words may stand elsewhere too; by hash, so never a wrong no."""
    x = ids.astype(np.uint64)
    h = x[:-3]
    for k in (1, 2, 3):
        h = (h + x[k : len(x) - 3 + k]) * _MIX
        h ^= h >> np.uint64(29)
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.zeros(0, bool)
    at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    return twice[at] == h


def _equal_after(ids: np.ndarray, j: int, d: int) -> int:
    """The first position from j on whose word differs from the one d words on, or that has none."""
    end, step = len(ids) - d, 32
    while j < end:
        k = min(step, end - j)
        differs = ids[j : j + k] != ids[j + d : j + d + k]
        first = int(differs.argmax())
        if differs[first]:
            return j + first
        j, step = j + k, step * 4
    return j


def _equal_before(ids: np.ndarray, j: int, d: int) -> int:
    """The least position up to j from which all words up to j equal those d words on."""
    step = 32
    while j > 0:
        k = min(step, j)
        differs = (ids[j - k : j] != ids[j - k + d : j + d])[::-1]
        first = int(differs.argmax())
        if differs[first]:
            return j - first
        j, step = j - k, step * 4
    return 0


def _doubled(names: np.ndarray, width: int) -> np.ndarray:
    """Names of the windows of twice the width: equal numbers for equal words."""
    pairs = names[:-width] * np.int64(len(names) + 1) + names[width:]
    return np.unique(pairs, return_inverse=True)[1].reshape(-1).astype(np.int64)


def _seeds(names: np.ndarray, width: int, size: int, passing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block position, distance) of the occurrences of aligned blocks of `size` words at distances of this scale.

    A letter is the name of the `width` words from a position on; a block is a key of size / width letters, and the text is searched
    once for each remainder of the positions by `width`, in one sequence.
    """
    low, high = (6, 6) if size == 2 else (1 if size == 4 else 2 * size - 1, 4 * size - 2)
    letters, found = size // width, []
    per = max(1, SEGMENT // size)
    for lo in range(int(passing[0]) // per * per, int(passing[-1]) + 1, per):
        blocks = passing[(passing >= lo) & (passing < lo + per)]
        if not len(blocks):
            continue
        keys: dict[tuple, int] = {}
        number = np.full(per, -1, np.int64)
        spelt = names[blocks[:, None] * size + np.arange(0, size, width)].tolist()
        for j, key in zip(blocks.tolist(), spelt):
            number[j - lo] = keys.setdefault(tuple(key), len(keys))
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for key, k in keys.items():
            automaton.add_word(key, k)
        automaton.make_automaton()
        first = int(blocks[0]) * size
        part = names[first : int(blocks[-1]) * size + high + size]
        rows = -(-len(part) // width) + 1  # at least one letter that no key has ends each remainder
        text = np.full(rows * width, len(names) + 1, np.int64)
        text[: len(part)] = part
        text = text.reshape(rows, width).T.reshape(-1)
        hits = np.fromiter(chain.from_iterable(automaton.iter(tuple(text.tolist()))), np.int64).reshape(-1, 2)
        at, key = hits[:, 0] - (letters - 1), hits[:, 1]
        at = at % rows * width + at // rows + first
        j = (at - low) // size  # the nearest block that is far enough
        for _ in range((high - low) // size + 1):
            ok = (j >= lo) & (j < lo + per) & (at - j * size <= high)
            ok[ok] = number[j[ok] - lo] == key[ok]
            found.append(np.stack([j[ok] * size, (at - j * size)[ok]]))
            j = j - 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b, d = np.concatenate(found, axis=1)
    return b, d


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in a sequence of word numbers, by start, then period."""
    n = len(ids)
    if n < LEAST:
        return []
    repeated = _repeated(ids)
    if not len(repeated):
        return []
    before = np.concatenate([[0], np.cumsum(repeated)])
    names, width = ids, 1
    runs: dict[tuple[int, int], int] = {}
    size = 2
    while size <= 4 or 2 * size - 1 <= n // 2:
        starts = np.arange(0, n - max(size, 4) + 1, size)
        ok = repeated[starts] if size == 2 else before[starts + size - 3] - before[starts] == size - 3
        passing = np.flatnonzero(ok)
        if len(passing):
            while 4 * width < size:
                names, width = _doubled(names, width), 2 * width
            b, d = _seeds(names, width, size, passing)
            order = np.lexsort((d, b))
            b, d = b[order], d[order]
            new = np.ones(len(b), bool)
            least = size + (2 * size - 1 if size > 4 else 1)
            for (s, e), q in runs.items():
                if e - s >= least:
                    lo, hi = np.searchsorted(b, [s, e - least + 1])
                    new[lo:hi] &= (d[lo:hi] % q != 0) | (b[lo:hi] + d[lo:hi] + size > e)
            order = np.lexsort((b[new], d[new]))
            distance, reach = 0, 0
            for at, far in zip(b[new][order].tolist(), d[new][order].tolist()):
                if far != distance:
                    distance, reach = far, 0
                if at < reach:
                    continue
                reach = _equal_after(ids, at + size, far)
                s, e = _equal_before(ids, at, far), reach + far
                if e - s >= max(LEAST, 2 * far):
                    runs[s, e] = min(far, runs.get((s, e), far))
        elif size > 2:
            break  # a longer block holds shorter ones
        size *= 2
    return sorted((s, e - s, q) for (s, e), q in runs.items())


def _runs_of(row: tuple) -> tuple:
    """A row's id and text to its id, number of words, runs and collapsed text."""
    words = row[1].split()
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    runs = find_runs(ids) if len(numbers) < len(words) else []
    if runs:
        kept = np.ones(len(words), bool)
        for start, length, period in runs:
            kept[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(kept).tolist()]
    return row[0], len(ids), runs, b" ".join(words).decode("utf-8", "replace")


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, runs (start, length and period in words, by start) and collapsed.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0.  `collapsed` keeps the words that no run holds after its first
    period, joined by one space.  Null, empty and blank texts have no words, no runs and an empty collapsed text; null ids and
    repeated rows are rows like others; an empty table gives an empty result.  Other columns are not read, so
    their names don't matter.  A text is one task's work, near n log n in its words whatever it repeats, and its memory is a few
    times the text's.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return map_rows(docs.select(F.col(id_col), utf8(text_col)), lambda: _runs_of, schema)


def _planted(row: tuple) -> tuple:
    """One text in ten, by the checksum of its id, ends in a period of its own; null ids stay as they are."""
    number, text = row
    if number is None:
        return number, text.decode("utf-8", "replace")
    h = zlib.crc32(str(number).encode())
    words = text.split() if h % 10 == 0 else []
    if not words:
        return number, text.decode("utf-8", "replace")
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return number, b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)]).decode("utf-8", "replace")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, one in ten of them with a periodic end: number, longest run and digests."""
    docs = texts_of(spark, sf_dir).select("doc_id", utf8("text").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = periodic_runs(map_rows(docs, lambda: _planted, f"doc_id {kind}, text string"))
    longest = F.expr("array_min(transform(runs, r -> struct(-r.length as l, r.start as start, r.period as period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    found = found.withColumns({"longest": longest, "lines": lines})
    length = -F.col("longest.l")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        length.alias("length"),
        F.col("longest.period").alias("period"),
        F.floor(1000 * length / F.col("longest.period")).cast("long").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
