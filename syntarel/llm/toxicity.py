"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text is the set of its hashed features: words, the first letters of longer
words, pairs and triples of words in a row, and pairs with one or two words
between them. Each coordinate learns at its own rate, and the L1 term leaves
few weights that aren't zero: these, and nothing else, are broadcast.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches

BITS = 18
#: Letters of the stems of longer words; distances between the words of a feature.
STEMS = (5, 7)
GAPS = ((1,), (1, 1), (2,), (3,))
#: Most labelled documents that the weights are fitted on, and most features of these together (4 bytes each reach the driver).
SAMPLE, SAMPLE_FEATURES = 6000, 12_000_000
#: The score from which label 1 is predicted, and how much more a share of clean documents above it counts than one of toxic ones below.
CUT, CLEAN = 0.5, 3.0

_WORD = re.compile(r"\w+")
#: Odd 64-bit multipliers.
_M = tuple(np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Hashes of words met before; emptied when it has grown.
_known: dict[tuple[str, int], int] = {}


def _ids(words: Sequence[str], letters: int = 0) -> np.ndarray:
    if len(_known) > 400_000:
        _known.clear()
    out = np.empty(len(words), np.uint64)
    for k, w in enumerate(words):
        h = _known.get((w, letters))
        if h is None:
            h = _known[w, letters] = zlib.crc32((w[:letters] if letters else w).encode("utf-8", "surrogatepass"), letters)
        out[k] = h
    return out


def _bucket(h: np.ndarray) -> np.ndarray:
    h = h * _M[0]
    h ^= h >> np.uint64(29)
    return ((h * _M[1]) >> np.uint64(64 - BITS)).astype(np.uint32)


def features(text: str | None) -> np.ndarray:
    """Buckets of all features of a whole text, repeated ones repeatedly; none without a word."""
    words = _WORD.findall((text or "").lower())
    ids = _ids(words)
    out = [_bucket(ids)]
    for letters in STEMS:
        out.append(_bucket(_ids([w for w in words if len(w) > letters], letters) * _M[1] + np.uint64(letters)))
    for number, gaps in enumerate(GAPS, 100):
        span = sum(gaps)
        if len(ids) > span:
            h, at = ids[:-span] * _M[1], 0
            for g in gaps:
                at += g
                h = (h ^ (h >> np.uint64(31))) * _M[2] + ids[at : len(ids) - span + at]
            out.append(_bucket(h * _M[3] + np.uint64(number)))
    return np.concatenate(out)


class SparseModel:
    """Buckets with a weight, their weights, and the intercept."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, intercept: float):
        self.buckets, self.weights, self.intercept = buckets, weights, intercept
        self._dense: np.ndarray | None = None

    def __getstate__(self):
        return {"buckets": self.buckets, "weights": self.weights, "intercept": self.intercept, "_dense": None}

    def logit(self, buckets: np.ndarray) -> float:
        """Of a text's features; each counts once."""
        if self._dense is None:
            self._dense = np.zeros(1 << BITS, np.float32)
            self._dense[self.buckets] = self.weights
        some = buckets[self._dense[buckets] != 0]
        return self.intercept + float(self._dense[np.unique(some)].sum(dtype=np.float64))

    def score(self, text: str | None) -> float:
        """Probability of label 1."""
        return float(1 / (1 + np.exp(-np.clip(self.logit(features(text)), -40, 40))))


def fit(bags: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1, epochs: int = 6, seed: int = 3) -> SparseModel:
    """FTRL-proximal over sets of buckets; the intercept is a further coordinate without L1.

    Coordinate i keeps z and n; its weight is 0 while \\|z| <= l1, else
    -(z - sign(z) l1) / ((beta + sqrt n) / alpha + l2).
    """
    size = 1 << BITS
    z, n, rng = np.zeros(size + 1), np.zeros(size + 1), np.random.default_rng(seed)

    def weights(zi: np.ndarray, ni: np.ndarray, least: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= least, 0.0, (np.sign(zi) * least - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            at = np.append(bags[i], size)
            least = np.full(len(at), l1)
            least[-1] = 0.0
            zi, ni = z[at], n[at]
            w = weights(zi, ni, least)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
    least = np.full(size + 1, l1)
    least[-1] = 0.0
    w = weights(z, n, least)
    at = np.flatnonzero(w[:-1])
    return SparseModel(at.astype(np.int32), w[at].astype(np.float32), float(w[-1]))


def calibrate(model: SparseModel, bags: list[np.ndarray], labels: np.ndarray) -> SparseModel:
    """Move the intercept so that CUT lies where the labels part best, shares of clean documents weighing CLEAN times those of toxic ones (in the middle of equally good places)."""
    logits = np.array([model.logit(x) for x in bags])
    order = np.argsort(logits, kind="stable")
    below = np.concatenate([[0.0], np.cumsum(np.where(labels[order] == 1, -1 / labels.sum(), CLEAN / (1 - labels).sum()))])
    edges = np.concatenate([logits[order[:1]], (logits[order[1:]] + logits[order[:-1]]) / 2, logits[order[-1:]]])
    best = edges[np.flatnonzero(below >= below.max() - 1e-9)]
    return SparseModel(model.buckets, model.weights, model.intercept + float(np.log(CUT / (1 - CUT)) - (best[0] + best[-1]) / 2))


def _packed(texts: pd.Series) -> pd.Series:
    return pd.Series([np.unique(features(x)).astype(np.uint32).tobytes() for x in texts])


def train_toxicity_model(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> SparseModel | float:
    """Fit on labelled rows of ``docs``; ``labels`` holds doc_id and ``label`` (0 or 1).

    At most ``sample`` documents, the first by a hash of their id; of these, in this
    order, as many as fit into SAMPLE_FEATURES (a document has 2 ** BITS at most, so
    there always are some), the others are passed over. Null labels and ids don't count; a
    document labelled more than once has its highest label, one with several texts
    the last in their order. Every fifth document of the sample calibrates, the
    others train; where one label is missing from the fifth, all do both. If only
    one label, or none, is there, the result is a constant score.
    """
    one = labels.select("doc_id", F.col(label).cast("int").alias("__label")).where("doc_id is not null and __label in (0, 1)").groupBy("doc_id").agg(F.max("__label").alias("__label"))
    chosen = one.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.first("__label").alias("__label"))
    total, y, bags = 0, [], []
    for row in rows.select("doc_id", "__label", F.pandas_udf(_packed, "binary")("text").alias("found")).orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():  # ``sample`` rows at most
        if total + len(row["found"]) // 4 <= SAMPLE_FEATURES:
            total += len(row["found"]) // 4
            y.append(row["__label"])
            bags.append(np.frombuffer(row["found"], np.uint32))
    y = np.array(y, float)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        return calibrate(fit(bags, y), bags, y)
    model = fit([b for b, h in zip(bags, held, strict=True) if not h], y[~held])
    return calibrate(model, [b for b, h in zip(bags, held, strict=True) if h], y[held])


def score_toxicity(docs: DataFrame, model: SparseModel | float, text: str = "text", into: str = "score") -> DataFrame:
    """Adds double ``into``: P(label 1) of each whole text; a null text or one without a word has the intercept's.

    All rows and other columns stay as they are, but for one named as ``into``, which
    is replaced; equal texts have equal scores.
    """
    if isinstance(model, float):
        return docs.withColumn(into, F.lit(model))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bound_batches(docs.sparkSession)

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(x) for x in texts], dtype="float64")

    return docs.withColumn(into, F.pandas_udf(run, T.DoubleType()).asNondeterministic()(F.col(text).cast("string")))
