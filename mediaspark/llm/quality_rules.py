"""Quality rules with a bitmask ledger.

Every rule is evaluated once for each document; the ledger keeps the measurements and one bit for each rule
that failed.  A policy is a versioned mask of rules that reject, so a new policy or an ablation needs
no second pass over the texts: it is bit arithmetic on the ledger.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_names, map_rows, texts_of, utf8

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, "
    "n_marked_words long, n_bars long, n_upper long, n_letters long, n_top_word long"
)
#: Bytes that do not start a code point.
_TAIL = bytes(range(0x80, 0xC0))
_NOT_SYMBOL = bytes(b for b in range(256) if b not in b"#*$%&|<>")
_UPPER = bytes(range(65, 91))
_ASCII_LETTERS = _UPPER + bytes(range(97, 123))
_NOT_UPPER = bytes(b for b in range(256) if b not in _UPPER)
_NOT_LETTER = bytes(b for b in range(256) if b not in _ASCII_LETTERS)
_MARKS = b"#*$%&<>!"


def measure(text: bytes) -> tuple:
    """The measurements of one UTF-8 text, in the order of MEASURES."""
    words = text.split()
    n = len(words)
    chars = len(b"".join(words).translate(None, _TAIL)) if n else 0
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeat = 0
    if n > 3:
        grams = list(zip(words, words[1:], words[2:]))
        if len(set(grams)) < len(grams):
            count = Counter(grams)
            last = -1  # the last word that is counted
            for i, g in enumerate(grams):
                if count[g] > 1:
                    repeat += i + 2 - max(last, i - 1)
                    last = i + 2
    marked = sum(1 for w in words if len(w) > 1 and w[-1] in _MARKS)
    return (
        n,
        chars,
        len(text.translate(None, _NOT_SYMBOL)),
        len(lines),
        len(lines) - len(set(lines)),
        repeat,
        marked,
        words.count(b"|"),
        len(text.translate(None, _NOT_UPPER)),
        len(text.translate(None, _NOT_LETTER)),
        Counter(words).most_common(1)[0][1] if n else 0,
    )


@dataclass(frozen=True)
class Rule:
    """A rule fails where `fails`, an SQL condition on the measurements, holds; whole numbers only, so every engine agrees."""

    bit: int
    name: str
    fails: str


#: Rules by bit; a bit is never given to another rule.
RULES = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbol_ratio", "100 * n_symbols > 30 * n_words"),
    Rule(3, "marked_words", "100 * n_marked_words > 30 * n_words"),
    Rule(4, "bar_lists", "100 * n_bars > 15 * n_words"),
    Rule(5, "duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines"),
    Rule(6, "shouting", "n_letters >= 100 AND 100 * n_upper > 60 * n_letters"),
    Rule(7, "long_words", "word_chars > 40 * n_words"),
    Rule(8, "one_word", "n_words >= 50 AND 100 * n_top_word > 40 * n_words"),
    Rule(9, "short_words", "10 * word_chars < 15 * n_words"),
)
#: Bits that reject, by version.  Version 1 rejects by the base rules alone.
POLICIES = {1: 0b0000000011, 2: 0b0111011111, 3: 0b1111111111}
CURRENT_POLICY = 3
BASE_BITS = POLICIES[1]


def _measured(docs: DataFrame, keep: tuple[str, ...], text_col: str) -> DataFrame:
    """k0, k1, ... for the columns of `keep`, the measurements and failed_bits, in one pass without a shuffle."""
    kept_cols = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    source = docs.select(*kept_cols, utf8(text_col).alias("t"))
    kinds = [f"k{i} {source.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))]

    def make():
        return lambda row: row[:-1] + measure(row[-1])

    bits: Column = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return map_rows(source, make, ", ".join([*kinds, MEASURES])).withColumn("failed_bits", bits)


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """`keep`, the measurements and `failed_bits`, one row a document.

    A null text counts as empty: all measurements 0, bit 0 set.  Repeated rows and ties get equal rows, an empty table none;
    very long texts are measured whole.  Any further columns of `docs` may be named in `keep`; one that is called like a
    measurement comes out with an underscore before its name.
    """
    outputs = [*[x.split()[0] for x in MEASURES.split(", ")], "failed_bits"]
    return _measured(docs, keep, text_col).select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(kept_names(keep, tuple(outputs)))], *outputs
    )


def kept(docs: DataFrame, policy: int | None = None, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns whatever their names, that a policy keeps.

    A null or empty text has too few words for every policy; repeated rows share a fate; an empty table stays empty.
    """
    columns = docs.columns
    rows = _measured(docs, tuple(columns), text_col).filter(~rejected(CURRENT_POLICY if policy is None else policy))
    return rows.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(columns)])


def rejected(policy: int = CURRENT_POLICY) -> Column:
    """Whether a row of the ledger is rejected under a policy."""
    return F.col("failed_bits").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) != 0


def ablations(rows: DataFrame, policy: int = CURRENT_POLICY) -> DataFrame:
    """What each rule of a policy does: documents failing it, failing it alone, and kept once it is left out.

    The ledger is first counted by its bits (at most 2 ** len(RULES) rows), then every rule reads those counts.
    """
    mask = POLICIES[policy]
    by_bits = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(
        F.count(F.lit(1)).alias("n")
    )
    rules = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit"))
                                for r in RULES if mask >> r.bit & 1])).alias("r")
    has = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("bits") == F.col("r.bit")
    passes = F.col("bits") == 0
    return (
        by_bits.select("bits", "n", rules)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("failed"),
            F.coalesce(F.sum(F.when(alone, F.col("n"))), F.lit(0)).alias("failed_alone"),
            F.coalesce(F.sum(F.when(passes | alone, F.col("n"))), F.lit(0)).alias("kept_without"),
        )
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measurements, the base verdict and the current policy's, and the failure bits, of all documents."""
    return ledger(texts_of(spark, sf_dir)).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (F.col("failed_bits").bitwiseAND(F.lit(BASE_BITS).cast("long")) != 0).alias("base_failed"),
        (~rejected()).alias("kept"),
        "failed_bits",
    )


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
pos AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3),
gram AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM pos),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM gram WHERE c > 1) GROUP BY r),
lines AS (SELECT r, l FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d)
          WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
ln AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dup FROM lines GROUP BY r),
each AS (SELECT r, unnest(w) AS x FROM w),
top AS (SELECT r, max(c) AS n FROM (SELECT r, x, count(*) AS c FROM each GROUP BY r, x) GROUP BY r),
mk AS (SELECT r, count(*) FILTER (WHERE regexp_matches(x, '^.+[#*$%&<>!]$')) AS marked,
              count(*) FILTER (WHERE x = '|') AS bars, sum(length(x)) AS chars FROM each GROUP BY r),
m AS (
  SELECT d.doc_id, len(w.w) AS n_words, coalesce(mk.chars, 0)::BIGINT AS word_chars,
         length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(ln.n_lines, 0) AS n_lines,
         coalesce(ln.dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(mk.marked, 0) AS n_marked_words,
         coalesce(mk.bars, 0) AS n_bars, length(regexp_replace(d.text, '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(d.text, '[^A-Za-z]', '', 'g')) AS n_letters, coalesce(top.n, 0) AS n_top_word
  FROM d JOIN w USING (r) LEFT JOIN ln USING (r) LEFT JOIN rep USING (r) LEFT JOIN mk USING (r) LEFT JOIN top USING (r)),
f AS (SELECT *, (""" + " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES) + r""")::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed_bits & """ + str(BASE_BITS) + r""" <> 0 AS base_failed,
       failed_bits & """ + str(POLICIES[CURRENT_POLICY]) + r""" = 0 AS kept, failed_bits
FROM f
"""
