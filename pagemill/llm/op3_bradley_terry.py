"""Quality scores by Bradley-Terry pairwise ranking.

Each text gets a strength, linear in its features; of a preferred and a
rejected text, the first wins with the logistic function of the difference of
strengths. Weights minimise the logistic loss over preference pairs (a text
labelled 1 and one labelled 0) by Newton steps on feature differences. The
threshold is the quantile of the strengths of the labelled sample at the share
of label 0; the score maps it to CUT and is monotone in strength.

Features are shares and ratios that any text has (repeated words and lines,
upper case, runs of symbols, separators, vocabulary, lengths), each cut at the
sample's quantiles into bins, so strength is a step function of each.

The fit takes a bounded sample, SAMPLE labelled rows chosen by the hash of
their id; scoring covers all rows and whole texts, without a shuffle.

Defined results: a null text is empty, and an empty text is scored like any
other; a very long text is scored whole, in one pass over it; labels other than 0 and 1
and null ids teach nothing; an id labelled twice counts once, with its smallest
label, and an id with several texts with the one of the smallest hash; without both labels all strengths
are equal and every text is kept; equal texts score alike; null ids and repeated
rows keep their rows; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole_text

SAMPLE = 20_000
PAIRS = 30_000
BINS = 12
CUT = 0.3
RIDGE = 1.0

_SYMBOLS = re.compile(r"[^\w\s]{2,}")
_PUNCT = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
_DIGITS, _UPPER = b"0123456789", bytes(range(0x41, 0x5B))


def features(text: str) -> list[float]:
    words, raw = text.split(), text.encode("utf-8", "replace")
    n, size = max(1, len(words)), max(1, len(raw))
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    without = lambda drop: (len(raw) - len(raw.translate(None, drop))) / size
    runs = len(_SYMBOLS.findall(text))
    again = sum(map(operator.eq, words, words[1:]))
    upper = sum(map(str.isupper, words))
    bars = text.count("|")
    return [
        np.log1p(len(words)), len(raw) / n, len(set(words)) / n, np.log(len(set(words)) + 1) / np.log(n + 1.5), again / n, np.log1p(again),
        sum(map(operator.eq, words, words[2:])) / n, upper / n, np.log1p(upper), runs / n, np.log1p(runs), bars / n, np.log1p(bars),
        without(_PUNCT), without(_DIGITS), without(_UPPER), 1 - len(set(lines)) / max(1, len(lines)), np.log1p(len(lines) - len(set(lines))), len(lines) / n, max(map(len, words), default=0),
    ]


@dataclass(frozen=True)
class Model:
    """edges: bin edges of each feature; weights: of all bins, one after another."""

    edges: list[np.ndarray]
    weights: np.ndarray
    threshold: float = 0.0
    slope: float = 1.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Index of each feature's bin among all weights."""
        out, base = np.empty(x.shape, np.int64), 0
        for j, e in enumerate(self.edges):
            out[:, j] = base + np.searchsorted(e, x[:, j], side="right")
            base += len(e) + 1
        return out

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.weights[self.bins(x)].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strength(x) - self.threshold) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 0) -> Model:
    """From features and labels (0 or 1) of the sample."""
    x = x.reshape(len(x), -1) if len(x) else np.zeros((0, len(features(""))))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    # a feature that is mostly zero also needs cuts among its other values
    for j in range(x.shape[1]):
        some = x[:, j][x[:, j] > 0]
        if len(some) and len(some) < len(x):
            edges[j] = np.unique(np.concatenate([edges[j], [np.nextafter(0, 1)], np.quantile(some, np.linspace(0, 1, BINS // 2 + 1)[1:-1])]))
    m = Model(edges, np.zeros(sum(len(e) + 1 for e in edges)))
    better, worse = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(better) or not len(worse):
        return Model(edges, m.weights, threshold=-1.0)
    rng, at = np.random.default_rng(seed), m.bins(x)
    dim = len(m.weights)
    onehot = np.zeros((len(x), dim), np.float32)
    np.put_along_axis(onehot, at, 1, axis=1)
    a, b = rng.choice(better, pairs), np.resize(rng.permutation(worse), pairs)
    w = np.zeros(dim)
    for _ in range(12):
        g, h = RIDGE * w, RIDGE * np.eye(dim)
        for i in range(0, pairs, 8192):
            d = (onehot[a[i : i + 8192]] - onehot[b[i : i + 8192]]).astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            g -= d.T @ (1 - p)
            h += (d * (p * (1 - p))[:, None]).T @ d
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-3:
            break
    s = w[at].sum(axis=1)
    q = float(np.quantile(s, len(worse) / len(x)))
    spread = float(s[y == 1].mean() - s[y == 0].mean())
    return Model(edges, w, q, 4 / spread if spread > 1e-9 else 1.0)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of `sample` labelled rows that are not held out."""
    few = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    own = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(few), "doc_id")

    @F.pandas_udf("array<double>")
    def feats(texts: pd.Series) -> pd.Series:
        return texts.map(features)

    # of several texts of one id, that with the smallest hash
    got = own.select("doc_id", "quality", F.xxhash64("text").alias("h"), feats("text").alias("x")).groupBy("doc_id").agg(F.min_by(F.struct("quality", "x"), "h").alias("y")).select("doc_id", "y.*").orderBy("doc_id").toArrow()
    x = np.array(got.column("x").to_pylist(), dtype=np.float64)
    return fit(x, got.column("quality").to_numpy())


def scorer(model: Model):
    """The model as a column function of a text column."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t) for t in texts], dtype=np.float64).reshape(len(texts), -1))) if len(texts) else pd.Series([], dtype="float64")

    return score


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    score = scorer(train(docs, labels))
    x = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), score(whole_text()).alias("score"))
    return x.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The rows of docs whose text scores CUT or more; learns from `labelled`, by default docs."""
    return docs.where(scorer(train(docs if labelled is None else labelled, labels))(whole_text()) >= CUT)


def op3_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from labels.quality."""
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
