"""Quality scores learned from preferences between documents.

A Bradley-Terry model: document a is preferred to b with probability
sigmoid(score(a) - score(b)), where a score is linear in features of the text.  It is fitted
by logistic loss on the feature differences of pairs of a good and a bad document, and the
threshold is the quantile of the scores below which the labelled share of bad ones lies.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import bring_back, set_aside

SAMPLE_ROWS = 20_000
PAIRS = 60_000
FOLDS = 3
HELD_OUT = 1
SENTENCE = b".,;:!?'\"()-"


def text_features(text: bytes) -> list[float]:
    """Figures about a whole text: bytes, words, lines and repetition."""
    n = len(text)
    if not n:
        return [0.0] * N_FEATURES
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = counts / n
    upper, lower, wide = share[65:91].sum(), share[97:123].sum(), share[128:].sum()
    usual = share[list(SENTENCE)].sum()
    space = share[9:14].sum() + share[32]
    used = share[share > 0]
    words = text.split()
    w = max(1, len(words))
    kinds = Counter(words)
    odd = bare = shout = 0
    for word, times in kinds.items():
        if word[-1] < 128 and not word[-1:].isalnum() and word[-1] not in SENTENCE:
            odd += times
        if not word[:1].isalpha() and word[0] < 128:
            bare += times
        if word.isupper() and len(word) > 1:
            shout += times
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    return [
        np.log1p(n), np.log1p(len(words)), np.log(n / w), upper / max(1e-9, upper + lower), upper + lower + wide,
        share[48:58].sum(), space, share[10], usual, share[33], share[124], share[35:39].sum() + share[42],
        1 - upper - lower - wide - usual - space - share[48:58].sum(), wide, float(-(used * np.log(used)).sum()),
        len(kinds) / w, max(kinds.values(), default=0) / w, repeats / w, odd / w, bare / w, shout / w,
        np.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)), np.log(w / max(1, len(lines))),
        len(zlib.compress(text, 1)) / n,
    ]


N_FEATURES = 25


def with_features(df: DataFrame, text: str = "text", out: str = "features") -> DataFrame:
    """Adds the features of a text; null and empty texts have zeros."""

    @F.arrow_udf(returnType="array<double>")
    def column(texts: pa.Array) -> pa.Array:
        return pa.array([text_features(t or b"") for t in texts.to_pylist()], pa.list_(pa.float64()))

    return df.withColumn(out, column(F.col(text).cast("binary")))


@dataclass(frozen=True)
class Model:
    """Scores are `weights` times the features and their squares, both standardised, over `threshold`."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    @staticmethod
    def expand(features: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
        z = np.clip((features - centre) / scale, -5, 5)
        return np.hstack([z, z * z])

    def margins(self, features: np.ndarray) -> np.ndarray:
        return self.expand(features, self.centre, self.scale) @ self.weights - self.threshold

    def score(self, features: Column) -> Column:
        """Between 0 and 1; 0.5 at the threshold."""
        total = F.lit(-self.threshold)
        for i, (c, s) in enumerate(zip(self.centre, self.scale, strict=True)):
            z = F.greatest(F.lit(-5.0), F.least(F.lit(5.0), (features[i] - float(c)) / float(s)))
            total = total + z * float(self.weights[i]) + z * z * float(self.weights[i + len(self.centre)])
        return 1 / (1 + F.exp(-total))


def fit(features: np.ndarray, good: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 8) -> Model:
    """Newton's method on the loss of `pairs` random pairs of a good and a bad row.

    Without rows of both kinds every score is 0.5.
    """
    d = features.shape[1]
    centre = features.mean(axis=0) if len(features) else np.zeros(d)
    scale = features.std(axis=0) if len(features) else np.ones(d)
    scale = np.where(scale > 1e-9, scale, 1.0)
    if not good.any() or good.all():
        return Model(centre, scale, np.zeros(2 * d), 0.0)
    x = Model.expand(features, centre, scale)
    pick = np.random.default_rng(seed)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    difference = x[pick.choice(better, pairs)] - x[pick.choice(worse, pairs)]
    weights = np.zeros(2 * d)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(difference @ weights, -30, 30)))
        slope = difference.T @ (1 - p) / pairs - ridge * weights
        bend = (difference * (p * (1 - p))[:, None]).T @ difference / pairs + ridge * np.eye(2 * d)
        step = np.linalg.solve(bend, slope)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    return Model(centre, scale, weights, float(np.quantile(x @ weights, (~good).mean())))


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def learn(featured: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits the model on at most `sample_rows` labelled rows, the first by a hash of their id.

    `featured` has `doc_id, features`, `labels` has `doc_id, quality`.  Rows of the held-out fold and
    rows without a label are not used; a document with several label rows counts for each.
    """
    known = labels.filter("quality is not null").select("doc_id", "quality").filter(fold() != HELD_OUT)
    rows = featured.join(known, "doc_id").select("doc_id", "features", "quality")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(sample_rows).toPandas()
    x = np.array(rows["features"].tolist(), dtype=float).reshape(-1, N_FEATURES)
    return fit(x, (rows["quality"].to_numpy() == 1))


def classify(featured: DataFrame, model: Model) -> DataFrame:
    """`doc_id, held_out, score, predicted` of every row of `doc_id, features`; a null id is not held out."""
    score = model.score(F.col("features"))
    rows = featured.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that score at least 0.5; the model is learned from `labels`.

    Null and empty texts are scored like any other.  An empty table gives no rows; without labels
    of both kinds every row stays.
    """
    model = learn(with_features(docs.select("doc_id", "text")), labels)
    rows = with_features(set_aside(docs, ["text"]), out="_features")
    return rows.filter(model.score(F.col("_features")) >= 0.5).select(*bring_back(docs.columns, ["text"]))
