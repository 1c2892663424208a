"""A quality classifier by positive-unlabelled learning.

Trusted positives, unlabelled texts and an estimated class prior train a linear classifier that minimises
the non-negative unbiased risk: prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)).
The prior too is estimated from positives and unlabelled texts; labelled negatives are used nowhere.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, kept_names, map_rows, remainder, staged, summed, table, texts_of, utf8

_MARKS = b"#*$%&<>!@^~|="
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b".,;:!?\"'()-")] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>@^~=_+{}[]\\/")] = True
_BYTE = np.arange(256)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_LOWER = (_BYTE >= 97) & (_BYTE <= 122)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_TAIL = (_BYTE >= 0x80) & (_BYTE < 0xC0)
_HIGH = _BYTE >= 0xC0


def features(text: bytes) -> list[float]:
    """Measurements of a text that bear on quality, each between about 0 and 1."""
    words = text.split()
    n = len(words)
    h = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, int)
    chars = max(1, int(h.sum() - h[_TAIL].sum()))
    letters = max(1, int(h[_UPPER].sum() + h[_LOWER].sum() + h[_HIGH].sum()))
    w = max(1, n)
    distinct = len(set(words))
    same = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
    marked = sum(1 for x in words if x[-1] in _MARKS and len(x) > 1)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    m = max(1, len(lines))
    dup = len(lines) - len(set(lines))
    urls = text.count(b"://") + text.count(b"www.")
    out = [
        min(1.0, np.log1p(n) / 10),
        1.0 if n < 5 else 0.0,
        1.0 if n < 30 else 0.0,
        min(1.0, chars / w / 20),
        1.0 if chars > 20 * w else 0.0,
        min(1.0, float(h[_UPPER].sum()) / letters),
        1.0 if h[_UPPER].sum() > 0.4 * letters else 0.0,
        float(h[_DIGIT].sum()) / chars,
        float(h[_PUNCT].sum()) / chars,
        min(1.0, 10 * float(h[_SYMBOL].sum()) / chars),
        1.0 if h[_SYMBOL].sum() > 0.05 * chars else 0.0,
        marked / w,
        1.0 if marked > 0.2 * w else 0.0,
        min(1.0, 5 * words.count(b"|") / w),
        min(1.0, 5 * float(h[33]) / w),
        distinct / w,
        1.0 if distinct < 0.2 * w else 0.0,
        min(1.0, 3 * same / w),
        1.0 if same > 0.2 * w else 0.0,
        dup / m,
        1.0 if dup > 0.5 * m else 0.0,
        min(1.0, n / m / 50),
        1.0 if n < 3 * m else 0.0,
        min(1.0, float(h[_HIGH].sum()) / letters),
        min(1.0, 10 * urls / w),
        min(1.0, 5 * float(h[64]) / w),
    ]
    return [float(x) for x in out]


N_FEATURES = len(features(b""))


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _logistic(standardised(x, self.mean, self.scale) @ self.weights + self.bias)


#: Bins of a score between 0 and 1.
BINS = 1_000


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def standardised(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -6, 6)


def risk_sums(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums over rows: 1, the loss of calling each negative, z, the gradients of both for (w, b), and the former's curvature."""
    x = np.column_stack([x, np.ones(len(x))])
    z = x @ w
    s = _logistic(z)
    curvature = x.T @ (x * (s * (1 - s))[:, None])
    return np.concatenate([[len(x), np.logaddexp(0, z).sum(), z.sum()], s @ x, x.sum(0), curvature.reshape(-1)])


def descend(f: Callable, w: np.ndarray, rounds: int = 20, tolerance: float = 1e-8) -> np.ndarray:
    """The minimum of a convex function by Newton's steps: f(w) gives (value, gradient, curvature).

    A step that does not lower the value enough is halved.
    """
    value, g, h = f(w)
    for _ in range(rounds):
        d = -np.linalg.solve(h + 1e-9 * np.eye(len(w)), g)
        slope, step = float(g @ d), 1.0
        if -slope <= tolerance:
            break
        for _ in range(10):
            then, *more = f(w + step * d)
            if then <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        w, value, (g, h) = w + step * d, then, more
    return w


#: How near the risk comes to its lower bound, as a share of it, and mixtures tried at most.
GAP, ROUNDS = 1e-3, 40

#: sums(mean, scale, w) gives risk_sums() of all texts, of the positives and of each of two halves of the positives.
Sums = Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]


def best_bin(unlabelled: np.ndarray, positive: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """Share of positives among unlabelled texts, by best bin estimation from counts of both by bins of a score.

    Of the texts over a threshold, positives have at most the share q_u / q_p; the threshold is taken at which the
    upper bound of that share, for samples of these sizes, is least.  No negative is needed.
    """
    n_u, n_p = unlabelled.sum(), positive.sum()
    if not n_u or not n_p:
        return 0.5
    q_u, q_p = unlabelled[::-1].cumsum() / n_u, positive[::-1].cumsum() / n_p
    slack = np.sqrt(np.log(4 / delta) / (2 * n_u)) + (1 + gamma) * np.sqrt(np.log(4 / delta) / (2 * n_p))
    seen = q_p > 0
    share, bound = q_u[seen] / q_p[seen], (q_u[seen] + slack) / q_p[seen]
    return float(np.clip(share[np.argmin(bound)], 0.02, 0.98))


def _parts(sums: np.ndarray, k: int) -> tuple:
    """Means of risk_sums() over its rows: loss, z, the gradients of both, and the curvature."""
    m = sums / max(1.0, sums[0])
    return m[1], m[2], m[3 : 3 + k], m[3 + k : 3 + 2 * k], m[3 + 2 * k :].reshape(k, k)


def _ridge(w: np.ndarray, decay: float) -> tuple[float, np.ndarray, np.ndarray]:
    v = np.append(w[:-1], 0)
    return decay / 2 * float(v @ v), decay * v, np.diag(np.append(np.full(len(w) - 1, decay), 0))


def train_told_apart(sums: Sums, mean: np.ndarray, scale: np.ndarray, decay: float = 1e-3) -> np.ndarray:
    """Weights that tell the first half of the positives from all texts, both weighing one half."""

    def f(w):
        k = len(w)
        u, _, p, _ = sums(mean, scale, w)
        (lu, _, gu, _, hu), (lp, zp, gp, xp, hp) = _parts(u, k), _parts(p, k)
        r, gr, hr = _ridge(w, decay)
        # The loss of calling a positive is that of calling it negative less z.
        return lu + lp - zp + r, gu + gp - xp + gr, hu + hp + hr

    return descend(f, np.zeros(len(mean) + 1))


def train_nnpu(sums: Sums, prior: float, mean: np.ndarray, scale: np.ndarray, decay: float = 1e-3) -> np.ndarray:
    """Weights and bias of least non-negative PU risk under the logistic loss.

    The risk is prior * R+(positives) + max(0, R-(all texts) - prior * R-(positives)): the greater of the unbiased risk and its positive
    part alone.  Both are convex under this loss, so it is.  Its minimum is that of the mixture of the two whose minimum leaves the
    negative part at 0, if that of the unbiased risk alone has it below 0.  The share of the unbiased risk in the mixture is searched for
    by secants, each step from the weights of the last one.  A mixture's minimum bounds the risk from below, and the search ends when the
    risk found is within GAP of that bound.
    """
    seen: dict[str, float] = {}

    def mixture(share: float) -> Callable:
        def f(w):
            k = len(w)
            u, p, *_ = sums(mean, scale, w)
            (lu, _, gu, _, hu), (lp, zp, gp, xp, hp) = _parts(u, k), _parts(p, k)
            r, gr, hr = _ridge(w, decay)
            unbiased, positive = lu - prior * zp, prior * (lp - zp)
            value = share * unbiased + (1 - share) * positive + r
            # Newton's steps end at one of the weights seen, that of least value.
            if value <= seen.get("value", np.inf):
                seen.update(value=value, negative=unbiased - positive, risk=max(unbiased, positive) + r)
            return (
                value,
                share * (gu - prior * xp) + (1 - share) * prior * (gp - xp) + gr,
                share * hu + (1 - share) * prior * hp + hr,
            )

        return f

    w, share = np.zeros(len(mean) + 1), 1.0
    low, at_low, high, at_high = 0.0, np.inf, 1.0, 0.0
    best, least = w, np.inf
    for _ in range(ROUNDS):
        seen.clear()
        w = descend(mixture(share), w)
        if seen["risk"] < least:
            best, least = w, seen["risk"]
        negative = seen["negative"]
        if (share == 1.0 and negative >= 0) or least - seen["value"] <= GAP * least:
            break
        # The negative part falls as the share of the unbiased risk grows.
        if negative > 0:
            low, at_low, at_high = share, negative, at_high / 2
        else:
            high, at_high, at_low = share, -negative, at_low / 2
        by_secant = low + (high - low) * at_low / (at_low + at_high) if np.isfinite(at_low) and at_low + at_high > 0 else np.nan
        share = by_secant if low < by_secant < high else (low + high) / 2
    return best


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_positive: int = 10_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> QualityModel:
    """Learn from the positive rows of `labels` (give training rows only) and from all texts without regard to labels.

    `max_positive` bounds the labelled ids that count as positives: those least by a hash.  All documents are measured
    once, and all enter the means, the scales, the class prior and the unlabelled risk.  Each step of the training is a pass
    over these measurements whose sums alone reach the driver, however often an id repeats or is null.

    The prior is estimated without negatives: weights that tell half of the positives from all texts give a score, and
    best_bin() compares how the other half and all texts lie on it.

    Null labels and null ids of labels are left out, null texts are empty, repeated rows count as often as they stand.
    Without documents or without a positive among them every text scores 0.5.  Very long texts are measured whole; other
    columns are not read.
    """
    half = F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(2)).cast("int") + 1
    good = (
        labels.filter((F.col(label_col) == 1) & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("_id"))
        .distinct()
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_positive)
        .withColumn("_half", half)
    )
    # At most max_positive ids are broadcast.
    texts = docs.select(F.col(id_col).alias("_id"), utf8(text_col).alias("_t")).join(F.broadcast(good), "_id", "left")
    measured = staged(
        map_rows(
            texts.select(F.coalesce("_half", F.lit(0)).alias("half"), "_t"),
            lambda: lambda row: (row[0], features(row[1])),
            "half int, x array<double>",
        ),
        "quality",
    )

    def rows(batch) -> tuple[np.ndarray, np.ndarray]:
        return batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(batch.num_rows, N_FEATURES)

    def moments(batch):
        half, x = rows(batch)
        return np.concatenate([[len(x), (half == 1).sum(), (half == 2).sum()], x.sum(0), (x * x).sum(0)])

    total = summed(measured, moments)
    if total is None or not total[1] + total[2]:
        discard(measured)
        return QualityModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0, 0.5)
    n, *_ = total
    mean = total[3 : 3 + N_FEATURES] / n
    scale = np.maximum(np.sqrt(np.maximum(total[3 + N_FEATURES :] / n - mean**2, 0)), 0.02)
    # With few positives both halves are all of them.
    split = min(total[1], total[2]) >= 20

    def sums(mean, scale, w):
        def of(batch):
            half, x = rows(batch)
            x = standardised(x, mean, scale)
            return np.concatenate([risk_sums(x, w), risk_sums(x[half == 1], w), risk_sums(x[half == 2], w)])

        u, a, b = np.split(summed(measured, of), 3)
        return [u, a + b, a, b] if split else [u, a + b, a + b, a + b]

    apart = train_told_apart(sums, mean, scale)

    def bins(batch):
        half, x = rows(batch)
        s = _logistic(standardised(x, mean, scale) @ apart[:-1] + apart[-1])
        at = np.minimum((s * BINS).astype(int), BINS - 1)
        own = half == 2 if split else half > 0
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at[own], minlength=BINS)]).astype(float)

    prior = best_bin(*np.split(summed(measured, bins), 2))
    w = train_nnpu(sums, prior, mean, scale)
    discard(measured)
    return QualityModel(mean, scale, w[:-1], float(w[-1]), prior)


def score(
    docs: DataFrame, model: QualityModel, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text"
) -> DataFrame:
    """`keep` and score, 0 to 1, of each whole text, in one pass without a shuffle.

    A null text counts as empty, each row gives one row (repeated ones too), an empty table none.  A kept column named score
    comes out as _score; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], utf8(text_col).alias("t"))
    kinds = [f"k{i} {source.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))]

    def make():
        m = sent.value
        return lambda row: (*row[:-1], float(m.score(np.array(features(row[-1])))))

    out = map_rows(source, make, ", ".join([*kinds, "score double"]))
    names = kept_names(keep, ("score",))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], "score")


THRESHOLD = 0.3


def training_rows(labels: DataFrame) -> DataFrame:
    """Rows of labels that may be learnt from."""
    return labels.filter(remainder("doc_id", 5) != 0)


def held_out() -> Column:
    return F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))


def op10_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of all documents, learnt from the labels that are not held out."""
    docs = texts_of(spark, sf_dir)
    model = fit(docs, training_rows(table(spark, sf_dir, "labels")))
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
