"""Toxicity scores by weak supervision.

Voters (lexicons and patterns) fire or keep silent on each text.  A generative label model estimates from
all votes of the corpus how often each voter fires under either class and how far voters depend on each
other given the class, and turns votes into posterior labels.  A linear classifier on words and word
beginnings, trained on the posterior labels of all documents, gives the score.  Given labels do two things: lexicons are mined
from them, and they tell the label model which of its two classes is the toxic one.

Voters 0 to 6 stem from a fixed English lexicon, 7 and 8 are patterns, 9 to 15 are lexicons mined from labelled
texts, so languages that the fixed lexicon lacks have voters too.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import (
    COUNTED, Memo, discard, in_arrow, kept_names, map_rows, minimise, parts_of, remainder, staged, summed, table, texts_of, utf8,
)

#: English insults by kind, one voter each.
LEXICON = (
    ("idiot", "moron", "fool", "imbecile", "dunce", "dimwit"),
    ("loser", "clown", "jerk", "creep", "freak", "coward"),
    ("scum", "trash", "garbage", "filth", "vermin"),
    ("stupid", "dumb", "pathetic", "worthless", "useless"),
    ("disgusting", "revolting", "repulsive", "hideous", "vile"),
)
VOTERS = 16
_EDGE = b".,;:!?\"'()[]{}<>*#$%&|-_=+~`/\\"
_SHOUT = re.compile(rb"!!")
_MASKED = re.compile(rb"[A-Za-z][*#$@%]{2,}[A-Za-z]")
_MARKS = re.compile(r"[\W_]+")
#: Characters of a word beyond which it is split at its marks.
LONG = 40
#: Word beginnings of these lengths, in characters, are features beside whole words.
PREFIXES = (4, 5, 6)


def features_of(word: bytes) -> list[str]:
    """The features of a lower-cased word: itself without marks at its edges, and its beginnings.

    A word of more than LONG characters is taken as the parts between its marks.
    """
    w = word.strip(_EDGE).decode("utf-8", "replace")
    parts = _MARKS.split(w) if len(w) > LONG else [w]
    return [f for w in parts if w for f in ("w" + w, *["p" + w[:n] for n in PREFIXES if len(w) > n])]


def lookup(index: dict[str, int]) -> Memo:
    """The indexed features of each word asked for."""
    return Memo(lambda w: tuple(index[f] for f in features_of(w) if f in index))


def found(text: bytes, memory: Memo) -> set[int]:
    """The indexed features that a text holds."""
    memory.trim()
    out: set[int] = set()
    for ids in map(memory.__getitem__, set(text.lower().split())):
        if ids:
            out.update(ids)
    return out


class Votes:
    """Vote bits of a text, given the mined features."""

    def __init__(self, mined: list[str]):
        self.kind: list[tuple[str, int]] = []
        self.index: dict[str, int] = {}
        for group, words in enumerate(LEXICON):
            for w in words:
                self.index["w" + w] = len(self.kind)
                self.kind.append(("fixed", group))
        for k, f in enumerate(f for f in mined if f not in self.index):
            self.index[f] = len(self.kind)
            self.kind.append((f[0], k % 3))
        self.memory = lookup(self.index)

    def __call__(self, text: bytes) -> tuple[int, list[int]]:
        """The vote bits and the indexed features."""
        ids = found(text, self.memory)
        bits = fixed = mined = 0
        for i in ids:
            kind, group = self.kind[i]
            if kind == "fixed":
                fixed += 1
                bits |= 1 << group
            else:
                mined += 1
                bits |= 1 << ((9 if kind == "w" else 12) + group)
        if fixed >= 2:
            bits |= 1 << 5
        if fixed >= 3:
            bits |= 1 << 6
        if _SHOUT.search(text):
            bits |= 1 << 7
        if _MASKED.search(text):
            bits |= 1 << 8
        if mined >= 2:
            bits |= 1 << 15
        return bits, sorted(ids)


@dataclass
class LabelModel:
    """Firing rate of each voter by class, dependence between voters given the class, and the class prior."""

    prior: float
    rates: np.ndarray  # 2 x VOTERS
    correlations: np.ndarray  # VOTERS x VOTERS
    weights: np.ndarray  # VOTERS

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        fire = np.log(self.rates[1] / self.rates[0])
        silent = np.log((1 - self.rates[1]) / (1 - self.rates[0]))
        return np.log(self.prior / (1 - self.prior)) + (x * fire + (1 - x) * silent) @ self.weights

    def posterior(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def unpack(bits: np.ndarray) -> np.ndarray:
    return (bits[:, None] >> np.arange(VOTERS) & 1).astype(float)


def fit_label_model(
    patterns: np.ndarray, counts: np.ndarray, gold: np.ndarray, gold_pos: np.ndarray, gold_neg: np.ndarray, rounds: int = 20
) -> LabelModel:
    """EM over vote patterns.

    patterns, counts: distinct vote bits of the corpus and their number of documents (at most 2 ** VOTERS rows).
    gold, gold_pos, gold_neg: the same for labelled training rows, by label; they anchor the classes.  Correlated
    voters share their weight: a voter's is 1 / (1 + the sum of its correlations given the class).
    """
    x, g = unpack(patterns), unpack(gold)
    n1, n0 = gold_pos.sum(), gold_neg.sum()
    prior = float(np.clip((n1 + 1) / (n1 + n0 + 2), 1e-3, 0.999))
    # Unlabelled rows weigh as much as labelled ones at most.
    scale = min(1.0, (n1 + n0) / max(1.0, counts.sum()))
    c = counts * scale
    model = LabelModel(prior, np.empty((2, VOTERS)), np.eye(VOTERS), np.ones(VOTERS))

    def set_rates(r: np.ndarray, c: np.ndarray) -> None:
        for k, (own, gw) in enumerate((((1 - r) * c, gold_neg), (r * c, gold_pos))):
            fired = own @ x + gw @ g + 0.5 * prior
            model.rates[k] = np.clip(fired / (own.sum() + gw.sum() + 1), 1e-4, 1 - 1e-4)

    set_rates(c * 0, c * 0)  # of the labelled rows alone
    for _ in range(rounds):
        r = model.posterior(x)
        set_rates(r, c)
        model.prior = float(np.clip((r @ c + n1 + 1) / (c.sum() + n1 + n0 + 2), 1e-3, 0.999))
        cov = np.zeros((VOTERS, VOTERS))
        for k, (own, gw) in enumerate((((1 - r) * c, gold_neg), (r * c, gold_pos))):
            dx, dg = x - model.rates[k], g - model.rates[k]
            cov += (dx * own[:, None]).T @ dx + (dg * gw[:, None]).T @ dg
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        model.correlations = cov / np.outer(sd, sd)
        off = np.clip(model.correlations, 0, 1)
        np.fill_diagonal(off, 0)
        model.weights = 1 / (1 + off.sum(1))
    return model


@dataclass
class ToxicityModel:
    """The linear classifier: features, their weights and the bias; and the label model that taught it."""

    features: list[str]
    weights: np.ndarray
    bias: float
    label_model: LabelModel | None


def loss_sums(offsets, ids, counts, target, weight, w: np.ndarray) -> np.ndarray:
    """Sums over rows of feature lists: the logistic loss against soft targets, and its gradient for (weights, bias).

    Row i holds the features ids[offsets[i]:offsets[i + 1]] and stands for counts[i] texts.
    """
    n = len(counts)
    rows = np.repeat(np.arange(n), np.diff(offsets))
    z = np.bincount(rows, w[ids], minlength=n) + w[-1]
    c = counts * weight
    d = c * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
    loss = c @ (np.logaddexp(0, z) - target * z)
    return np.concatenate([[loss], np.bincount(ids, d[rows], minlength=len(w) - 1), [d.sum()]])


def train_linear(sums, size: int, total: float, decay: float = 3e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets: sums(w) gives loss_sums() of all texts, `total` in number."""

    def f(w):
        s = sums(w) / total
        v = np.append(w[:-1], 0)
        return s[0] + decay / 2 * (v @ v), s[1:] + decay * v

    w = minimise(f, np.zeros(size + 1))
    return w[:-1], float(w[-1])


def class_weights(share: float) -> tuple[float, float]:
    """Weights of clean and toxic: each class weighs one half in total, tempered, so a rare class is learnt too."""
    share = float(np.clip(share, 0.02, 0.98))
    return (0.5 / (1 - share)) ** 0.5, (0.5 / share) ** 0.5


#: Least number of toxic labelled texts that a mined feature stands in, the least share of toxic ones among its texts, and by how
#: many standard deviations the toxic ones outnumber what chance gives.
MINED_TEXTS, MINED_SHARE, MINED_SIGMA = 4, 0.6, 5.0


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_labelled: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> ToxicityModel:
    """Learn from the rows of `labels` (give training rows only) and the unlabelled votes of all of `docs`.

    `max_labelled` bounds the labelled ids used, those least by a hash; lexicons are all the features that their texts
    show to be toxic ones beyond chance.  Vote statistics and classifier cover all documents: their votes and lexicon
    features are written once as a table of distinct rows with counts, and each step of the training is a pass over it, whose
    sums alone reach the driver, however many rows an id has.

    Labels that are null, or of a null id, are left out, a null text is empty, repeated ids count once for the labels and
    each row of `docs` is a text.  Without labelled texts of both classes only the fixed lexicon votes, each of its words with one
    weight; so with an empty table.  Very long texts are read whole; columns other than id and text are not read.
    """
    spark = docs.sparkSession
    gold = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(F.col(label_col)).cast("int").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_labelled)
    )
    texts = docs.select(F.col(id_col).alias("_id"), utf8(text_col).alias("_t"))
    # At most max_labelled ids and labels are broadcast.
    sample = staged(texts.join(F.broadcast(gold), "_id").select("_y", "_t"), "labelled")
    n = {r["_y"]: r["n"] for r in sample.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    mined = _mine(sample, n.get(1, 0), n.get(0, 0)) if n.get(1) and n.get(0) else []
    index = Votes(mined).index
    sent = spark.sparkContext.broadcast(mined)

    def make_votes():
        votes = Votes(sent.value)
        return lambda row: (row[0], *votes(row[1]))

    if not (n.get(1) and n.get(0)):
        discard(sample)
        return ToxicityModel(list(index), np.full(len(index), 4.0), -4.0, None)
    ddl = "y int, bits int, x array<int>"
    everything = map_rows(texts.select(F.lit(0).alias("y"), "_t"), make_votes, ddl)
    # Most texts hold few lexicon features or none, so the distinct rows are few.
    table_ = staged(everything.groupBy("bits", "x").agg(F.count(F.lit(1)).alias("n")), "votes")
    # At most 2 ** VOTERS rows reach the driver, of all texts and of the labelled ones.
    patterns = table_.groupBy("bits").agg(F.sum("n").alias("n")).toPandas()
    known = (
        map_rows(sample, make_votes, ddl)
        .groupBy("bits")
        .agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
        .toPandas()
    )
    as_array = lambda s, kind=float: np.asarray(s, dtype=kind)
    bits, counts = as_array(patterns["bits"], np.int64), as_array(patterns["n"])
    label_model = fit_label_model(
        bits, counts, as_array(known["bits"], np.int64), as_array(known["pos"]), as_array(known["neg"])
    )
    posterior = np.zeros(1 << VOTERS)
    posterior[bits] = label_model.posterior(unpack(bits))
    clean, toxic = class_weights(float(counts @ posterior[bits] / counts.sum()))
    sent_posterior = spark.sparkContext.broadcast(posterior)

    def sums(w):
        def of(batch):
            x = batch.column(1)
            ids = x.flatten().to_numpy()
            offsets = x.offsets.to_numpy() - x.offsets[0].as_py()
            target = sent_posterior.value[batch.column(0).to_numpy()]
            return loss_sums(offsets, ids, batch.column(2).to_numpy(), target, target * toxic + (1 - target) * clean, w)

        return summed(table_, of)

    w, b = train_linear(sums, len(index), float(counts.sum()))
    discard(sample, table_)
    return ToxicityModel(list(index), w, b, label_model)


def _mine(sample: DataFrame, n_pos: int, n_neg: int) -> list[str]:
    """Features that toxic texts of `sample` (_y, _t) hold more often than chance gives, strongest first."""
    counts = (
        sample.transform(in_arrow, _class_counts, "f string, p long, n long")
        .groupBy("f")
        .agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    )
    share = n_pos / (n_pos + n_neg)
    p, n = F.col("p"), F.col("n")
    told = counts.filter(
        (p >= max(MINED_TEXTS, round(0.004 * n_pos)))
        & (p >= MINED_SHARE * n)
        & (p - share * n >= MINED_SIGMA * F.sqrt(n * share * (1 - share)))
    )
    # Each stands in a part of the labelled toxic texts, of which there are max_labelled at most.
    return [r["f"] for r in sorted(told.collect(), key=lambda r: (-(r["p"] ** 2) / (r["p"] + 3 * (r["n"] - r["p"])), r["f"]))]


def _class_counts(batches):
    """Toxic texts and all texts that hold each feature; a task sums its own first."""
    import pyarrow as pa

    counts: dict[str, list[int]] = {}
    used = 0

    def out():
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), *[pa.array([c[i] for c in counts.values()], pa.int64()) for i in (0, 1)]],
            names=["f", "p", "n"],
        )

    for batch in parts_of(batches):
        y, t = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_y", "_t"))
        for label, text in zip(y, t):
            for f in {f for w in set(text.lower().split()) for f in features_of(w)}:
                c = counts.get(f)
                if c is None:
                    c = counts[f] = [0, 0]
                    used += 150 + len(f)
                c[0] += label
                c[1] += 1
            if used > COUNTED:
                yield out()
                counts, used = {}, 0
    if counts:
        yield out()


def score(
    docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text"
) -> DataFrame:
    """`keep` and score, 0 to 1, of each whole text, in one pass without a shuffle.

    A null text counts as empty, each row gives one row (repeated ones too), an empty table none.  Only text is read
    for the score; a kept column named score comes out as _score.  The model is all that is broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.bias))
    source = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], utf8(text_col).alias("t"))
    kinds = [f"k{i} {source.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))]

    def make():
        features, weights, bias = sent.value
        memory = lookup({f: i for i, f in enumerate(features)})

        def row(values):
            ids = sorted(found(values[-1], memory))
            z = bias + float(weights[ids].sum()) if ids else bias
            return (*values[:-1], 1 / (1 + float(np.exp(-min(30.0, max(-30.0, z))))))

        return row

    out = map_rows(source, make, ", ".join([*kinds, "score double"]))
    names = kept_names(keep, ("score",))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], "score")


THRESHOLD = 0.7


def training_rows(labels: DataFrame) -> DataFrame:
    """Rows of labels that may be learnt from."""
    return labels.filter(remainder("doc_id", 3) != 1)


def held_out() -> Column:
    return F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of all documents, learnt from the labels that are not held out."""
    docs = texts_of(spark, sf_dir)
    model = fit(docs, training_rows(table(spark, sf_dir, "labels")))
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
