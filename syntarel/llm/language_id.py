"""Language identification by multilingual mixture inference.

Each language has a smoothed character-trigram distribution over a fixed
number of hash buckets. A document is a bag of trigrams drawn from a mixture
of languages: expectation-maximisation estimates the mixture's proportions,
and the language set is chosen by penalised likelihood (a language joins the
set only if the gain in log-likelihood exceeds the BIC penalty).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, materialize, release

BUCKETS = 1 << 16
#: Most languages that are looked at together: 256 KB each, so a broadcast stays below 64 MB. More go block by block.
MAX_LANGUAGES = 256
UNKNOWN = "und"

_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS


def trigrams(text: str) -> np.ndarray:
    """Buckets of the text's lower-cased trigrams around each letter; others count as spaces."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = _letters()[points]
    points = np.where(is_letter, points, 0).astype(np.uint32)
    keep = is_letter[1:-1]
    h = points[:-2][keep] * np.uint32(0x9E3779B1) + points[1:-1][keep] * np.uint32(0x85EBCA6B) + points[2:][keep] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(16)


def count_trigrams(train: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, bucket, n): trigram counts of all rows, summed per task before the shuffle."""

    def count(batches):
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for body, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name not in sums:
                    sums[name] = np.zeros(BUCKETS, np.int64)
                grams = trigrams(body)
                if len(grams) > BUCKETS // 8:
                    sums[name] += np.bincount(grams, minlength=BUCKETS)
                else:
                    np.add.at(sums[name], grams, 1)
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "bucket", "n"])

    rows = train.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    bound_batches(train.sparkSession)
    parts = rows.mapInArrow(count, "lang string, bucket int, n long")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Trigram distributions of the learned languages; at most MAX_LANGUAGES x BUCKETS floats."""

    def __init__(self, names: list[str], probabilities: np.ndarray):
        self.names, self.probabilities = names, probabilities

    @classmethod
    def from_counts(cls, counts: DataFrame, smoothing: float = 0.5, seen: int | None = None) -> LanguageModel:
        """From a written table of counts. The driver gets one row of BUCKETS floats a language: the model itself. ``seen``: buckets that any language has."""
        seen = seen or max(1, counts.select("bucket").distinct().count())

        def estimate(rows: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(BUCKETS)
            total[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
            total += smoothing
            return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "p": [(total / (total.sum() - smoothing * (BUCKETS - seen))).astype(np.float32).tobytes()]})

        rows = sorted(counts.groupBy("lang").applyInPandas(estimate, "lang string, p binary").collect())
        table = np.array([np.frombuffer(r[1], np.float32) for r in rows]).reshape(len(rows), BUCKETS)
        return cls([r[0] for r in rows], np.ascontiguousarray(table.T))

    def infer(self, text: str | None, iterations: int = 40, penalty: float = 1.0) -> tuple[str, float, dict[str, float]]:
        """Main language, its score (its proportion times its posterior among single languages) and the proportions.

        A text is its different buckets with their counts, so it takes at most
        BUCKETS rows however long it is.
        """
        grams, times = bag(text)
        if not len(grams) or not self.names:
            return UNKNOWN, 0.0, {}
        return _choose(self.names, self.probabilities[grams], times, iterations, penalty)

    def narrow(self, text: str | None, known: list[tuple[str, bytes]], others: float | None, iterations: int = 40) -> tuple[list[tuple[str, bytes]], float]:
        """``known`` (names and likelihoods of a text's buckets) and those of this model's languages that can be in its mixture, too; and the log of the summed likelihoods of the languages left out so far.

        Those that stand for less than a gram in the mixture of all of these can't
        pay the penalty; the likeliest one stays in any case.
        """
        grams, times = bag(text)
        if not len(grams):
            return [], -np.inf
        likely = np.concatenate([np.array([np.frombuffer(p, np.float32) for _, p in known], np.float32).reshape(len(known), len(grams)).T, self.probabilities[grams]], 1)
        single = _single(likely, times)
        share = _mixture(likely, times, iterations)[0] * times.sum(dtype=np.float64)
        kept = (np.arange(len(share)) < len(known)) | (share >= 1)
        kept[int(np.argmax(single))] = True
        left = [single[~kept], [-np.inf if others is None else others]]
        names = [*[n for n, _ in known], *self.names]
        return [(names[k], np.ascontiguousarray(likely[:, k]).tobytes()) for k in np.flatnonzero(kept)], float(np.logaddexp.reduce(np.concatenate(left)))


class LanguageBlocks:
    """More than MAX_LANGUAGES languages: their names, and a model of each block of them when it is asked for."""

    def __init__(self, counts: DataFrame, names: list[str], seen: int):
        self.counts, self.names, self._seen = counts, names, seen

    def models(self) -> Iterator[LanguageModel]:
        for at in range(0, len(self.names), MAX_LANGUAGES):
            low, high = self.names[at], self.names[min(at + MAX_LANGUAGES, len(self.names)) - 1]
            yield LanguageModel.from_counts(self.counts.where(F.col("lang").between(low, high)), seen=self._seen)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Different buckets of a text, ascending, and how often each is found."""
    if not text:
        return np.zeros(0, np.uint32), np.zeros(0, np.float32)
    grams, times = np.unique(trigrams(text), return_counts=True)
    return grams, times.astype(np.float32)


def _single(likely: np.ndarray, times: np.ndarray) -> np.ndarray:
    return (np.log(likely) * times[:, None]).sum(0, dtype=np.float64)


def _choose(names: list[str], likely: np.ndarray, times: np.ndarray, iterations: int = 40, penalty: float = 1.0, others: float = -np.inf) -> tuple[str, float, dict[str, float]]:
    """The set of languages by penalised likelihood. ``others``: log of the summed likelihoods of languages that aren't among ``names``."""
    n = float(times.sum(dtype=np.float64))
    single = _single(likely, times)
    order = np.argsort(-single, kind="stable")
    chosen, best, shares = [int(order[0])], float(single[order[0]]), np.ones(1)
    cost = penalty * max(1.0, np.log(n)) + 2.0
    if len(names) > 1:
        full, _ = _mixture(likely, times, iterations)
        # A language that stands for less than a gram can't pay the penalty.
        for k in sorted((int(k) for k in np.flatnonzero(full * n >= 1) if k != chosen[0]), key=lambda k: -full[k]):
            w, fit = _mixture(likely[:, [*chosen, k]], times, iterations)
            if fit - best > cost:
                chosen, best, shares = [*chosen, k], fit, w
    post = np.exp(single - single.max())
    post /= post.sum() + np.exp(others - single.max())
    top = int(np.argmax(shares))
    k = chosen[top]
    alone = float(post[k]) if len(chosen) == 1 else 1.0
    return names[k], float(min(1.0, max(0.0, shares[top] * alone))), {names[c]: float(s) for c, s in zip(chosen, shares, strict=True)}


def _mixture(likely: np.ndarray, times: np.ndarray, iterations: int) -> tuple[np.ndarray, float]:
    """Proportions by expectation-maximisation, and the log-likelihood, of grams found so many times."""
    k, n = likely.shape[1], times.sum(dtype=np.float64)
    w = np.full(k, 1 / k, np.float32)
    for _ in range(iterations):
        new = w * ((times / (likely @ w)) @ likely) / np.float32(n)
        moved = float(np.abs(new - w).max())
        w = new
        if moved < 2e-3:
            break
    return w / w.sum(), float((times * np.log(likely @ w)).sum(dtype=np.float64))


RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("shares", T.MapType(T.StringType(), T.DoubleType()))])


def train_language_model(train: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel | LanguageBlocks:
    """Learn from every row with a text and a language. The names of the languages, and of MAX_LANGUAGES at a time the models, reach the driver."""
    counts = materialize(count_trigrams(train, text, lang), "trigrams")
    names = sorted(r[0] for r in counts.select("lang").distinct().collect())
    if len(names) > MAX_LANGUAGES:
        return LanguageBlocks(counts, names, max(1, counts.select("bucket").distinct().count()))
    model = LanguageModel.from_counts(counts)
    release(counts)
    return model


def detect_language(docs: DataFrame, model: LanguageModel | LanguageBlocks, text: str = "text", into: str = "language") -> DataFrame:
    """Adds struct ``into`` (lang_pred, score, shares) to every row.

    Null texts and texts without a letter get (``und``, 0, {}). All rows and
    other columns stay as they are, repeated rows included; ties between
    languages go to the first by name. A column named ``into`` is replaced. With more
    than MAX_LANGUAGES languages the rows are gone through once for every block
    of these, and written each time with the languages that can be in their mixture.
    """
    bound_batches(docs.sparkSession)
    if isinstance(model, LanguageBlocks):
        return _detect_by_blocks(docs, model, text, into)
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.probabilities))

    def infer(texts: pd.Series) -> pd.DataFrame:
        known = LanguageModel(*shared.value)
        return pd.DataFrame([known.infer(x) for x in texts], columns=["lang_pred", "score", "shares"])

    udf = F.pandas_udf(infer, RESULT).asNondeterministic()
    return docs.withColumn(into, udf(_as_text(text)))


_FOUND = "struct<names:array<string>,likely:array<binary>,others:double>"


def _detect_by_blocks(docs: DataFrame, model: LanguageBlocks, text: str, into: str) -> DataFrame:
    def narrowed(shared):
        def run(texts: pd.Series, found: pd.DataFrame) -> pd.DataFrame:
            block, rows = LanguageModel(*shared.value), []
            for x, names, likely, others in zip(texts, found["names"], found["likely"], found["others"], strict=True):
                kept, left = block.narrow(x, list(zip(names, likely, strict=True)) if names is not None else [], None if names is None else others)
                rows.append(([n for n, _ in kept], [p for _, p in kept], left))
            return pd.DataFrame(rows, columns=["names", "likely", "others"])

        return F.pandas_udf(run, _FOUND).asNondeterministic()

    def choose(texts: pd.Series, found: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for x, names, likely, others in zip(texts, found["names"], found["likely"], found["others"], strict=True):
            grams, times = bag(x)
            if not len(grams):
                rows.append((UNKNOWN, 0.0, {}))
                continue
            by_name = sorted(zip(names, likely, strict=True))  # ties go to the first by name
            rows.append(_choose([n for n, _ in by_name], np.array([np.frombuffer(p, np.float32) for _, p in by_name]).T, times, others=others))
        return pd.DataFrame(rows, columns=["lang_pred", "score", "shares"])

    rows = docs.withColumn(into, F.lit(None).cast(_FOUND))
    for block in model.models():
        shared = docs.sparkSession.sparkContext.broadcast((block.names, block.probabilities))
        before, rows = rows, materialize(rows.withColumn(into, narrowed(shared)(_as_text(text), F.struct(f"{into}.names", f"{into}.likely", f"{into}.others"))), "languages")
        shared.destroy()
        release(before)
    return rows.withColumn(into, F.pandas_udf(choose, RESULT).asNondeterministic()(_as_text(text), F.col(into)))


def _as_text(name: str) -> Column:
    return F.col(name).cast("string")
