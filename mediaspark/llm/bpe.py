"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The texts of a batch are cut into pieces by the tokenizer's pattern.  The distinct pieces not met before
form a small corpus of byte symbols; an inverted index from merge rank (that is, from token pair) to word
positions is built over all of it, and the merges are replayed in rank order: each takes its list of
positions, joins the pair there and touches only the pairs with the two neighbours.  Pieces are
independent of each other, so replaying a batch gives the ids that each text would get alone.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from heapq import heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_names, map_chunks, texts_of

#: Bytes of pieces and ids that a Python worker remembers; beyond it the memory starts anew.
MEMORY = 96 << 20
#: Distinct pieces in one replay, and their bytes, at most; a longer piece is replayed alone.
BATCH, BATCH_BYTES = 2_000, 1 << 20
_BYTES = [bytes([i]) for i in range(256)]


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}


def replay(pieces: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """The ids of each piece: all merges over all pieces at once, in rank order, leftmost first.

    Symbols lie in flat lists, `nxt` and `prv` link the live ones of a piece; a separator (None) ends a piece.  `made` holds
    the rank that the symbol at a position makes with its next one, -1 for none.  A list of the index may hold stale positions; a
    position counts only if it still makes this rank.  If a merge makes a pair of lower rank than its own, that one is replayed first.
    """
    if not pieces:
        return []
    get = ranks.get
    data = b"\0".join(pieces) + b"\0"
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1) - 1
    heads = [0, *(ends[:-1] + 1).tolist()]
    size = len(data)
    symbols: list[bytes | None] = list(map(_BYTES.__getitem__, data))
    for end in ends.tolist():
        symbols[end] = None
    # The first pairs are of bytes: each kind is looked up once.
    flat = np.frombuffer(data, np.uint8).astype(np.int64)
    code = np.append(flat[:-1] << 8 | flat[1:], 0)
    rank_of = np.full(1 << 16, -1, np.int64)
    kinds = np.flatnonzero(np.bincount(code, minlength=1 << 16))
    rank_of[kinds] = [get(k.to_bytes(2), -1) for k in kinds.tolist()]
    first = rank_of[code]
    first[ends] = -1
    first[ends - 1] = -1
    made = first.tolist()
    at = np.flatnonzero(first >= 0)
    at = at[np.argsort(first[at], kind="stable")]
    heap, starts = np.unique(first[at], return_index=True)
    heap = heap.tolist()
    where: dict[int, list[int]] = {r: x.tolist() for r, x in zip(heap, np.split(at, starts[1:]))}
    nxt = list(range(1, size + 1))
    prv = list(range(-1, size - 1))
    while heap:
        rank = heappop(heap)
        positions = where.pop(rank, None)
        if not positions:
            continue
        positions.sort()
        merged = None
        for k, i in enumerate(positions):
            if made[i] != rank:
                continue
            j = nxt[i]
            if merged is None:
                merged = symbols[i] + symbols[j]
            symbols[i] = merged
            symbols[j] = None
            made[j] = -1
            after = nxt[i] = nxt[j]
            prv[after] = i
            lower = False
            c = symbols[after]
            r = -1 if c is None else get(merged + c, -1)
            made[i] = r
            if r >= 0:
                if r in where:
                    where[r].append(i)
                else:
                    where[r] = [i]
                    heappush(heap, r)
                lower = r < rank
            before = prv[i]
            if before >= 0 and (c := symbols[before]) is not None:
                r = made[before] = get(c + merged, -1)
                if r >= 0:
                    if r in where:
                        where[r].append(before)
                    else:
                        where[r] = [before]
                        heappush(heap, r)
                    lower = lower or r < rank
            if lower and k + 1 < len(positions):
                where[rank] = positions[k + 1 :]
                heappush(heap, rank)
                break
    out = []
    for head in heads:
        ids = []
        i = head
        while (s := symbols[i]) is not None:
            ids.append(ranks[s])
            i = nxt[i]
        out.append(ids)
    return out


class Codec:
    """Encoder and decoder of one tokenizer; remembers pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.memory: dict[str, bytes] = {}
        self.used = 0
        self.token = {str(r).encode(): t for t, r in ranks.items()}
        self.decimal = {r: b"%d " % r for r in ranks.values()}

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """For each text its ids in decimal, with one space after each.

        The many lists of a replay refer to nothing that refers back, so the collector, which would walk them over and over, waits.
        """
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encode_batch(texts)
        finally:
            if collects:
                gc.enable()

    def _encode_batch(self, texts: list[str]) -> list[bytes]:
        cut = [self.find(x) for x in texts]
        if self.used > MEMORY:
            self.memory.clear()
            self.used = 0
        memory = self.memory
        batch, size = [], 0
        for p in {p for pieces in cut for p in pieces if p not in memory}:
            if len(batch) == BATCH or (batch and size + len(p) > BATCH_BYTES):
                self._learn(batch)
                batch, size = [], 0
            batch.append(p)
            size += len(p)
        self._learn(batch)
        return [b"".join(map(memory.__getitem__, pieces)) for pieces in cut]

    def _learn(self, new: list[str]) -> None:
        whole, rest = [], []
        for p in new:
            b = p.encode()
            rank = self.ranks.get(b)
            self.used += 5 * len(b) + 200
            if rank is None:
                rest.append((p, b))
            else:
                whole.append((p, rank))
        for p, rank in whole:
            self.memory[p] = self.decimal[rank]
        for (p, _), ids in zip(rest, replay([b for _, b in rest], self.ranks)):
            self.memory[p] = b"".join(map(self.decimal.__getitem__, ids))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids given in decimal, separated by spaces."""
        return b"".join(map(self.token.__getitem__, ids.split()))


#: The last codec that this Python worker built; it lives on in the tasks that follow.
_codec: tuple[object, Codec] | None = None


def _codec_of(key: str, data: bytes, pattern: str) -> Codec:
    global _codec
    if _codec is None or _codec[0] != (key, pattern):
        _codec = ((key, pattern), Codec(parse_ranks(data), pattern))
    return _codec[1]


def encode(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    keep: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
    digests: bool = False,
) -> DataFrame:
    """Encode each text and decode its ids again: `keep`, n_tokens and ids with intact, or with `digests` two SHA-256.

    `vocabulary` is the path of a rank file on the driver; its content (the one table that is broadcast,
    of the tokenizer's fixed size) goes to the executors.  ids is array<int>; intact tells whether the decoded
    ids give the text's bytes again.  With `digests`
    ids_sha256 is of the decimal ids joined by one space, decoded_sha256 of the decoded bytes.  A null text counts as
    empty and has no tokens; every row gives one row, repeated ones too, and an empty table none.  Very long texts and
    words are encoded whole.  A kept column that is called like an output comes out with an underscore before its name.
    """
    with open(vocabulary, "rb") as f:
        data = f.read()
    key = hashlib.sha256(data).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(data)
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    source = docs.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    kinds = [f"k{i} {source.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))]
    result = "n long, a string, b string" if digests else "n long, a array<int>, b boolean"

    def make():
        codec = _codec_of(key, sent.value, pattern)

        def result_of(ids: bytes, text: str) -> tuple:
            decoded = codec.decode(ids)
            if digests:
                return ids.count(b" "), hashlib.sha256(ids[:-1]).hexdigest(), hashlib.sha256(decoded).hexdigest()
            return ids.count(b" "), [int(x) for x in ids.split()], decoded == text.encode()

        return lambda rows: [
            (*row[:-1], *result_of(ids, row[-1])) for row, ids in zip(rows, codec.encode_batch([row[-1] for row in rows]))
        ]

    out = map_chunks(source, make, ", ".join([*kinds, result]), lambda row: len(row[-1]))
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "intact")
    return out.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(kept_names(keep, ("n_tokens", *names)))],
        F.col("n").alias("n_tokens"),
        F.col("a").alias(names[0]),
        F.col("b").alias(names[1]),
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes of all documents."""
    import public_tokenizers

    return encode(
        texts_of(spark, sf_dir),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        digests=True,
    )
