"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage of the whole text is encoded as
square-root frequencies of byte classes and hashed byte pairs; a small network
embeds it, gated attention weighs the passages, and the weighted sum is scored.
Document labels are all the supervision there is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, materialize, release

PASSAGE = 512
SINGLES, PAIRS = 129, 384
WIDTH = SINGLES + PAIRS + 2
#: Most labelled documents that the network is fitted on, and most of their passages.
SAMPLE, SAMPLE_PASSAGES = 3000, 24_000
#: The score from which label 1 is predicted.
CUT = 0.3


def encode(text: str | None) -> np.ndarray:
    """passages x WIDTH; an empty text is one empty passage."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    m = max(1, -(-len(raw) // PASSAGE))
    out = np.zeros((m, WIDTH), np.float32)
    if len(raw):
        at = np.arange(len(raw)) // PASSAGE
        size = np.bincount(at, minlength=m).astype(np.float32)[:, None]
        single = np.minimum(raw, 128).astype(np.int64)
        out[:, :SINGLES] = np.sqrt(np.bincount(at * SINGLES + single, minlength=m * SINGLES).reshape(m, SINGLES) / size)
        pair = ((raw[:-1].astype(np.uint32) * np.uint32(0x9E3779B1) + raw[1:].astype(np.uint32) * np.uint32(0x85EBCA6B)) >> np.uint32(8)) % PAIRS
        out[:, SINGLES : SINGLES + PAIRS] = np.sqrt(np.bincount(at[:-1] * PAIRS + pair.astype(np.int64), minlength=m * PAIRS).reshape(m, PAIRS) / size)
        out[:, -2] = size[:, 0] / PASSAGE
        # Repetition: share of eight-byte windows of a passage that it has had before.
        if len(raw) >= 8:
            eight = np.lib.stride_tricks.sliding_window_view(raw, 8).copy().view(np.uint64).ravel() ^ (at[: len(raw) - 7].astype(np.uint64) << np.uint64(40))
            _, first = np.unique(eight, return_index=True)
            total = np.bincount(at[: len(raw) - 7], minlength=m)
            fresh = np.bincount(at[: len(raw) - 7][first], minlength=m)
            out[:, -1] = 1 - fresh / np.maximum(1, total)
    return out


class AttentionModel:
    """Embedding, gated attention over a document's passages, and a linear score."""

    def __init__(self, hidden: int = 32, gate: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        init = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.p = {"E": init(WIDTH, hidden) * 3, "e": np.zeros(hidden, np.float32), "V": init(hidden, gate), "U": init(hidden, gate), "w": init(gate, 1), "c": init(hidden, 1), "d": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict:
        p, size = self.p, np.diff(np.append(starts, len(x)))
        z = np.tanh(x @ p["E"] + p["e"])
        a, g = np.tanh(z @ p["V"]), 1 / (1 + np.exp(-(z @ p["U"])))
        s = (a * g @ p["w"])[:, 0]
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), size))
        s /= np.repeat(np.add.reduceat(s, starts), size)
        rep = np.add.reduceat(s[:, None] * z, starts, axis=0)
        return {"z": z, "a": a, "g": g, "s": s, "rep": rep, "size": size, "logit": (rep @ p["c"])[:, 0] + p["d"][0]}

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, decay: float) -> dict:
        p, f = self.p, self.forward(x, starts)
        dl = (1 / (1 + np.exp(-f["logit"])) - y).astype(np.float32) / len(y)
        drep = np.repeat(dl[:, None] * p["c"][:, 0], f["size"], axis=0)
        ds = (drep * f["z"]).sum(1)
        ds = f["s"] * (ds - np.repeat(np.add.reduceat(f["s"] * ds, starts), f["size"]))
        dgate = ds[:, None] * p["w"][:, 0]
        da, dg = dgate * f["g"] * (1 - f["a"] ** 2), dgate * f["a"] * f["g"] * (1 - f["g"])
        dz = (f["s"][:, None] * drep + da @ p["V"].T + dg @ p["U"].T) * (1 - f["z"] ** 2)
        out = {"E": x.T @ dz, "e": dz.sum(0), "V": f["z"].T @ da, "U": f["z"].T @ dg, "w": (f["a"] * f["g"]).T @ ds[:, None], "c": f["rep"].T @ dl[:, None], "d": dl.sum(keepdims=True)}
        return {k: v + decay * p[k] for k, v in out.items()}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.004, decay: float = 1e-5, seed: int = 11) -> AttentionModel:
        rng, step = np.random.default_rng(seed), 0
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                sizes = [len(bags[i]) for i in some]
                grads = self.gradients(np.concatenate([bags[i] for i in some]), np.cumsum([0, *sizes[:-1]]), labels[some], decay)
                step += 1
                for k, g in grads.items():
                    m1[k] += 0.1 * (g - m1[k])
                    m2[k] += 0.001 * (g * g - m2[k])
                    self.p[k] = (self.p[k] - rate * (1 - epoch / epochs) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def calibrate(self, bags: list[np.ndarray], labels: np.ndarray, cut: float = CUT) -> AttentionModel:
        """Shift the logits so that ``cut`` lies where both labels are told apart best, each weighing the same (in the middle of equally good places)."""
        logits = np.concatenate([self.forward(x, np.zeros(1, np.int64))["logit"] for x in bags])
        order = np.argsort(logits, kind="stable")
        below = np.concatenate([[0.0], np.cumsum(np.where(labels[order] == 1, -1 / labels.sum(), 1 / (1 - labels).sum()))])
        edges = np.concatenate([logits[order[:1]], (logits[order[1:]] + logits[order[:-1]]) / 2, logits[order[-1:]]])
        best = edges[np.flatnonzero(below >= below.max() - 1e-9)]
        self.p["d"] = self.p["d"] + np.float32(np.log(cut / (1 - cut)) - (best[0] + best[-1]) / 2)
        return self

    def score(self, text: str | None) -> float:
        """Probability of label 1."""
        f = self.forward(encode(text), np.zeros(1, np.int64))
        return float(1 / (1 + np.exp(-np.clip(f["logit"][0], -40, 40))))


def train_quality_model(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> AttentionModel | float:
    """Fit on labelled rows of ``docs``; ``labels`` holds doc_id and ``label`` (0 or 1).

    At most ``sample`` documents, the first by a hash of their id, and of these in
    this order all that fit into SAMPLE_PASSAGES passages together; a document that
    doesn't is passed over. If none fits, the first of each label are taken with evenly spaced
    passages of theirs, SAMPLE_PASSAGES for all. Null labels and ids don't count; a document labelled
    more than once has its highest label, one with several texts the last in their
    order. If only one label, or none, is there, the result is a constant score.
    """
    one = labels.select("doc_id", F.col(label).cast("int").alias("__label")).where("doc_id is not null and __label in (0, 1)").groupBy("doc_id").agg(F.max("__label").alias("__label"))
    chosen = one.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.first("__label").alias("__label"))
    rows = materialize(rows.withColumn("__size", F.greatest(F.lit(1), F.ceil(F.octet_length("text") / PASSAGE)).cast("long")), "labelled")
    fits, total = [], 0
    sizes = rows.select("doc_id", "__size").orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # ``sample`` rows at most
    for doc_id, size in sizes:
        if total + size <= SAMPLE_PASSAGES:
            fits.append(doc_id)
            total += size
    spaced = bool(sizes) and not fits
    if spaced:
        by_label = {r["__label"]: r["doc_id"] for r in rows.groupBy("__label").agg(F.min_by("doc_id", F.struct(F.xxhash64("doc_id"), "doc_id")).alias("doc_id")).collect()}
        fits = sorted(by_label.values())
    most = SAMPLE_PASSAGES // max(1, len(fits)) if spaced else None

    def encoded(texts: pd.Series) -> pd.Series:
        return pd.Series([sampled(encode(x), most).astype(np.float16).tobytes() for x in texts])

    got = rows.where(F.col("doc_id").isin(fits)).orderBy("doc_id").select("__label", F.pandas_udf(encoded, "binary")("text")).collect()
    release(rows)
    y = np.array([r[0] for r in got], np.float32)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    bags = [np.frombuffer(r[1], np.float16).reshape(-1, WIDTH).astype(np.float32) for r in got]
    return AttentionModel().fit(bags, y).calibrate(bags, y)


def sampled(passages: np.ndarray, most: int | None) -> np.ndarray:
    """``most`` evenly spaced passages, or all."""
    return passages if most is None or len(passages) <= most else passages[np.linspace(0, len(passages) - 1, most).astype(int)]


def score_documents(docs: DataFrame, model: AttentionModel | float, text: str = "text", into: str = "score") -> DataFrame:
    """Adds double ``into``: P(label 1) of each whole text, empty and null ones included.

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
