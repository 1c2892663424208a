"""Token counts of a unigram tokenizer by count-only Viterbi.

An Aho-Corasick automaton enumerates the vocabulary's matches in a word; dynamic programming over end
positions carries only the best score and its number of pieces, never the pieces.  Ties follow the
`tokenizers` library's unigram model: starts are tried from left to right and a later start replaces
an earlier one only by a strictly greater score.
"""

from __future__ import annotations

import hashlib

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, kept_names, map_rows, texts_of

SPACE = "▁"
#: Below the lowest score of the vocabulary, for a character without a piece of its own.
UNKNOWN_PENALTY = 10.0


class Counter:
    """Counts the pieces of texts under a unigram vocabulary [(piece, score)].

    As in a tokenizer that prepends SPACE and replaces each space by it, without other normalising.  A
    character that no piece covers counts as its UTF-8 bytes where the vocabulary has all byte
    pieces (`<0x00>` to `<0xFF>`), else a run of such characters counts as one unknown piece.
    No piece may hold SPACE after another character, or a line end: text is cut there, and each cut is one
    that every segmentation has.
    """

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.scores = dict(vocabulary)
        self.bytes_known = all(f"<0x{b:02X}>" in self.scores for b in range(256))
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.scores):
            raise ValueError("a piece crosses a word boundary")
        self.unknown = min(self.scores.values()) - UNKNOWN_PENALTY
        self.matches = ahocorasick.Automaton()
        for p, s in self.scores.items():
            if p:
                self.matches.add_word(p, (len(p), s))
        self.matches.make_automaton()
        self.memory = Memo(self.word)

    def word(self, word: str) -> int:
        """Pieces of a word that no boundary cuts."""
        size = len(word)
        # best[i]: score of the best way to end at i, pieces on it, and whether it ends in an unknown run.
        best: list[tuple[float, int, bool] | None] = [None] * (size + 1)
        best[0] = (0.0, 0, False)
        at: list[list[tuple[int, float]]] = [[] for _ in range(size)]
        single = [False] * size
        for end, (length, score) in self.matches.iter(word):
            at[end + 1 - length].append((end + 1, score))
            if length == 1:
                single[end] = True
        for i in range(size):
            here = best[i]
            if here is None:  # no way leads here
                continue
            total, count, run = here
            for end, score in at[i]:
                old = best[end]
                if old is None or total + score > old[0]:
                    best[end] = (total + score, count + 1, False)
            if not single[i]:
                score = total + self.unknown
                old = best[i + 1]
                if old is None or score > old[0]:
                    more = len(word[i].encode()) if self.bytes_known else int(not run)
                    best[i + 1] = (score, count + more, True)
        return best[size][1]

    def count(self, text: str) -> int:
        if not text:
            return 0
        self.memory.trim()
        if not self.bytes_known:  # a run of unknown characters counts once, and it may cross any boundary
            return self.word((" " + text).replace(" ", SPACE))
        lines = (" " + text).replace(SPACE, " ").split("\n")
        total = len(lines) - 1  # the byte piece of each line end
        for line in lines:
            if "  " in line:
                words = _spaced(line)
            else:
                first, *rest = line.split(" ")
                words = ([first] if first else []) + [SPACE + w for w in rest]
            total += sum(map(self.memory.__getitem__, words))
        return total


def _spaced(line: str) -> list[str]:
    """The words of a line, each with all spaces before it; spaces at the end are a word."""
    words, spaces = [], 0
    first, *rest = line.split(" ")
    if first:
        words.append(first)
    for w in rest:
        spaces += 1
        if w:
            words.append(SPACE * spaces + w)
            spaces = 0
    if spaces:
        words.append(SPACE * spaces)
    return words


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and stored scores of a sentencepiece model file, taken as a unigram vocabulary; control pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        (model.id_to_piece(i), model.get_score(i))
        for i in range(model.get_piece_size())
        if not model.is_control(i) and not model.is_unknown(i)
    ]


_counter: tuple[str, Counter] | None = None


def _counter_of(key: str, vocabulary: list[tuple[str, float]]) -> Counter:
    global _counter
    if _counter is None or _counter[0] != key:
        _counter = (key, Counter(vocabulary))
    return _counter[1]


def count_tokens(
    docs: DataFrame,
    vocabulary: list[tuple[str, float]],
    keep: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
) -> DataFrame:
    """`keep`, n_chars, n_bytes and n_tokens of each whole text, in one pass without a shuffle.

    A null or empty text has no tokens.  Every row gives one row, so repeated rows stay; an empty table gives none.  Very long
    texts and words are counted whole.  A kept column that is called like an output comes out with an underscore before its
    name.  The vocabulary, of the tokenizer's fixed size, is all that is broadcast.
    """
    key = hashlib.sha256(repr(vocabulary).encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    source = docs.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    kinds = [f"k{i} {source.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))]

    def make():
        count = _counter_of(key, sent.value).count
        return lambda row: (*row[:-1], len(row[-1]), len(row[-1].encode()), count(row[-1]))

    out = map_rows(source, make, ", ".join([*kinds, "n_chars long, n_bytes long, n_tokens long"]))
    outputs = ("n_chars", "n_bytes", "n_tokens")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept_names(keep, outputs))], *outputs)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, n_bytes and n_tokens of all documents."""
    import public_tokenizers

    return count_tokens(
        texts_of(spark, sf_dir), read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    )
