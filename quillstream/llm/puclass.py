"""A quality classifier from trusted positives and unlabelled text (non-negative PU learning).

The risk of a scorer g is estimated as  p E+[l(g)] + max(0, Eu[l(-g)] - p E+[l(-g)])  with logistic
loss l, class prior p, positives "+" and unlabelled texts "u". Labels of negatives are never read. The prior
is estimated from scores alone: a scorer that tells positives from unlabelled texts is fitted on one half of
the sample, and on the other half the share of unlabelled texts above a threshold, over that of positives
above it, is bounded; the least such bound is the prior, since above the best threshold hardly any text is
of the other class.

The scorer is a small network over statistics of the whole text. Their mean and spread are taken over all
texts of the training fold; the network is fitted on the driver on bounded samples of positives and of
unlabelled texts (SAMPLE_POSITIVE, SAMPLE_UNLABELLED), chosen by a hash of the id, so the same rows give the
same model everywhere.

Rows whose crc32(id as text) mod 3 is 1 are held out: neither their labels nor their texts are used.

Defined results: a null or empty text has statistics of zero and gets the score of such a text; a text of any
length is measured whole; equal texts get equal scores, and rows that repeat an id are scored each (for the fit
one of them is taken); a null id is scored, counts as not held out and has no label; without any positive
label every score is 1; an empty table gives no rows; other columns pass through with_score, which replaces a
column of the score's own name, and are ignored by classify.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm._support import named, ship, stored

SAMPLE_POSITIVE, SAMPLE_UNLABELLED = 6_000, 12_000
HIDDEN, STEPS, RATE, DECAY = 16, 300, 0.03, 1e-4
SYMBOLS = b"#*$%&|<>!?.,:;\"'()[]{}=_/\\@+-"
N_FEATURES = 18 + len(SYMBOLS)


def statistics(text: str | None) -> np.ndarray:
    """Statistics of a whole text; none depends on language, source or id."""
    out = np.zeros(N_FEATURES)
    words = (text or "").split()
    n = len(words)
    if not n:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    size = len(raw)
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.uint64)
    lengths = np.array([len(w) for w in number], dtype=float)
    counts = np.bincount(ids.astype(np.int64))
    share = counts / n
    letters = byte[65:91].sum() + byte[97:123].sum()
    lines = [x for x in text.split("\n") if x.strip()]
    out[0] = math.log1p(n)
    out[1] = len(number) / n
    out[2] = (len(number) / n) * math.log1p(n)  # distinct words fall with length; the two together tell
    out[3] = -(share * np.log(share)).sum() / math.log(n + 1)
    out[4] = math.log1p(counts.max()) / math.log1p(n)
    mean = (lengths * counts).sum() / n
    out[5] = mean
    out[6] = math.sqrt(max(0.0, (lengths**2 * counts).sum() / n - mean * mean))
    out[7] = math.log1p(lengths.max())
    if n > 2:
        k = np.uint64(0x9E3779B97F4A7C15)
        pairs = ids[:-1] * k + ids[1:]
        out[8] = 1 - len(np.unique(pairs)) / len(pairs)
        triples = (pairs[:-1] * k) ^ (ids[2:] + np.uint64(1))
        out[9] = 1 - len(np.unique(triples)) / len(triples)
    out[10] = 1 - len(set(lines)) / len(lines)
    out[11] = math.log1p(n / len(lines))
    out[12] = byte[65:91].sum() / max(1, letters)
    out[13] = byte[48:58].sum() / size
    out[14] = byte[128:].sum() / size
    out[15] = (byte[9:14].sum() + byte[32]) / size
    out[16] = byte[list(SYMBOLS)].sum() / size
    p = byte[byte > 0] / size
    out[17] = -(p * np.log(p)).sum()
    out[18:] = np.sqrt(byte[list(SYMBOLS)] / size)
    return out


class Scorer:
    """Standardised statistics, one hidden layer, a logistic output."""

    def __init__(self, mean, scale, w1, b1, w2, b2):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2 = mean, scale, w1, b1, w2, b2

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        g = np.tanh(self.standard(x) @ self.w1 + self.b1) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def prior_of(positive: np.ndarray, unlabelled: np.ndarray, risk: float = 0.1) -> float:
    """The share of positives among unlabelled scores: the least upper bound of the ratio of shares above a threshold.

    positive, unlabelled: scores of texts that the scorer was not fitted on; bounds hold with probability 1 - risk.
    """
    slack = lambda n: math.sqrt(math.log(4 / risk) / (2 * max(1, n)))
    least = np.sort(positive)
    at = np.unique(least)
    above = 1 - np.searchsorted(least, at, "left") / len(least)
    others = 1 - np.searchsorted(np.sort(unlabelled), at, "left") / len(unlabelled)
    room = slack(len(positive)) + slack(len(unlabelled))
    best = int(np.argmin((others + room) / above))
    return float(min(1.0, others[best] / above[best]))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> float:
    """Fit on one half of the rows, measure on the other, and the other way round; the mean of both."""
    halves = []
    for k in (0, 1):
        if len(positive[k::2]) and len(positive[1 - k :: 2]) and len(unlabelled[1 - k :: 2]) and len(unlabelled[k::2]):
            model = fit(positive[k::2], unlabelled[k::2], 0.5, mean, scale, steps=STEPS // 2, correct=False)
            halves.append(prior_of(model.score(positive[1 - k :: 2]), model.score(unlabelled[1 - k :: 2])))
    return float(min(0.98, max(0.02, np.mean(halves)))) if halves else 0.5


def fit(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float, mean: np.ndarray, scale: np.ndarray, seed: int = 7, steps: int = STEPS, correct: bool = True
) -> Scorer:
    """Minimise the non-negative risk by Adam over all sampled rows at each step.

    Without correct: tell positives from unlabelled rows, both sides of equal weight at a prior of one half.
    """
    rng = np.random.default_rng(seed)
    d = unlabelled.shape[1]
    theta = [rng.normal(0, 1 / math.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    model = Scorer(mean, scale, *theta)
    x = np.concatenate([model.standard(positive), model.standard(unlabelled)])
    n = len(positive)
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, steps + 1):
        w1, b1, w2, b2 = theta
        h = np.tanh(x @ w1 + b1)
        s = 1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30)))  # l(g) has slope s - 1, l(-g) slope s
        loss_negative = -np.log(np.maximum(1 - s, 1e-12))
        negative = loss_negative[n:].mean() - prior * loss_negative[:n].mean()
        slope = np.empty(len(x))
        if not correct:
            slope[:n] = prior * (s[:n] - 1) / n
            slope[n:] = (1 - prior) * s[n:] / (len(x) - n)
        elif negative >= 0:
            slope[:n] = prior * (s[:n] - 1 - s[:n]) / n
            slope[n:] = s[n:] / (len(x) - n)
        else:  # the estimate of the negatives' risk has overfitted: step back up
            slope[:n] = prior * s[:n] / n
            slope[n:] = -s[n:] / (len(x) - n)
        gh = (slope[:, None] * w2) * (1 - h * h)
        grads = [x.T @ gh + DECAY * w1, gh.sum(0), h.T @ slope + DECAY * w2, np.array([slope.sum()])]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            theta[i] = theta[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Scorer(mean, scale, *theta)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): statistics of every text, a table in the shared folder."""
    ship(docs.sparkSession)
    of = F.pandas_udf(lambda s: pd.Series([statistics(t).tolist() for t in s]), "array<double>")
    return stored(docs.select(named(docs, "doc_id").alias("doc_id"), of(named(docs, "text")).alias("x")), "text-statistics")


def train(rows: DataFrame, labels: DataFrame) -> Scorer | None:
    """Fit on the training fold of measured rows."""
    fold = rows.where(F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    x = [F.get("x", F.lit(k)) for k in range(N_FEATURES)]
    moments = fold.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(x)], *[F.stddev_pop(c).alias(f"s{k}") for k, c in enumerate(x)]).first()
    if moments["m0"] is None:
        return None
    mean, scale = (np.array([moments[f"{c}{k}"] for k in range(N_FEATURES)]) for c in "ms")
    scale = np.maximum(scale, 1e-3)
    trusted = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("doc_id").distinct()

    def sample(of: DataFrame, size: int) -> np.ndarray:
        """About size of the ids at most: those whose hash lies below a bound, so no task gathers a list of its own."""
        n = of.count()
        below = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, size / max(1, n)))
        picked = of.where(below).groupBy("doc_id").agg(F.min("x").alias("x")).toPandas().sort_values("doc_id")
        return np.array(picked["x"].tolist()).reshape(-1, N_FEATURES)

    positive, unlabelled = sample(fold.join(trusted, "doc_id", "left_semi"), SAMPLE_POSITIVE), sample(fold, SAMPLE_UNLABELLED)
    if not len(positive) or not len(unlabelled):
        return None
    return fit(positive, unlabelled, estimated_prior(positive, unlabelled, mean, scale), mean, scale)


def with_score(docs: DataFrame, scorer: Scorer | None, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs and a score between 0 and 1, in one pass over the texts; a column of that name is replaced."""
    if scorer is None:
        return docs.withColumn(name, F.lit(1.0))
    model = docs.sparkSession.sparkContext.broadcast(scorer)  # a few kB

    def of(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in texts]).reshape(-1, N_FEATURES)
        return pd.Series(model.value.score(x))

    return docs.withColumn(name, F.pandas_udf(of, "double")(named(docs, text_col)))


def scored(rows: DataFrame, scorer: Scorer | None) -> DataFrame:
    """(doc_id, score) of measured rows, without another look at the texts."""
    if scorer is None:
        return rows.select("doc_id", F.lit(1.0).alias("score"))
    model = rows.sparkSession.sparkContext.broadcast(scorer)
    of = F.pandas_udf(lambda x: pd.Series(model.value.score(np.array(x.tolist()).reshape(-1, N_FEATURES))), "double")
    return rows.select("doc_id", of("x").alias("score"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score 0.5 or more, with their own columns; without any positive label, all."""
    scorer = train(measured(docs), labels)
    own = docs.select(F.struct(*[named(docs, c).alias(c) for c in docs.columns]).alias("own"), named(docs, "text").alias("text"))
    return with_score(own, scorer).where("score >= 0.5").select("own.*")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of docs."""
    rows = measured(docs)
    return scored(rows, train(rows, labels)).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
