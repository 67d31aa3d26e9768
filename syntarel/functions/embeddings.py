"""Embedding providers, run as batched functions over a column."""

from __future__ import annotations

import json
import math
import time
import urllib.request
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EmbeddingSettings
from .hashing import hash32_of

DIMENSIONS = 768


class Provider(Protocol):
    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...

    def dimensions(self) -> int: ...

    def model(self) -> str: ...

    def available(self) -> bool: ...


class MockProvider:
    """Deterministic unit vectors, seeded by the text's hash."""

    def __init__(self, size: int = DIMENSIONS, name: str = "mock"):
        self._size, self._name = size, name

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        state, out = abs(hash32_of(text)), []
        for _ in range(self._size):
            state = int(float(state) * 1103515245.0 + 12345.0) & 0x7FFFFFFF  # in doubles, whose rounding is part of the result
            out.append(state / 0x7FFFFFFF * 2 - 1)
        norm = math.sqrt(sum(x * x for x in out))
        return [x / norm for x in out]

    def dimensions(self) -> int:
        return self._size

    def model(self) -> str:
        return self._name

    def available(self) -> bool:
        return True


class HttpProvider:
    """A local embedding server's ``/api/embed``; one model for the index and one for queries."""

    def __init__(self, settings: EmbeddingSettings, for_search: bool = False):
        self._settings, self._model = settings, settings.search_model if for_search else settings.warm_model
        self._size = DIMENSIONS

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self._settings.api_key}"} if self._settings.api_key else {})
        request = urllib.request.Request(f"{self._settings.base_url}/api/embed", json.dumps({"model": self._model, "input": texts}).encode(), headers)
        with urllib.request.urlopen(request, timeout=120) as answer:
            found = json.load(answer)["embeddings"]
        self._size = len(found[0]) if found else self._size
        return found

    def dimensions(self) -> int:
        return self._size

    def model(self) -> str:
        return self._model

    def available(self) -> bool:
        try:
            with urllib.request.urlopen(f"{self._settings.base_url}/api/tags", timeout=3) as answer:
                return answer.status == 200
        except OSError:
            return False


class SentenceProvider:
    """A local sentence model, where its library is installed: mean pooling, unit length."""

    #: One batch at a time: the model uses all cores by itself.
    serial = True

    def __init__(self, name: str):
        self._name, self._loaded = name, None

    def _get(self):
        if self._loaded is None:
            from sentence_transformers import SentenceTransformer

            self._loaded = SentenceTransformer(self._name)
        return self._loaded

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return self._get().encode(texts, normalize_embeddings=True).tolist()

    def dimensions(self) -> int:
        return self._get().get_sentence_embedding_dimension()

    def model(self) -> str:
        return self._name

    def available(self) -> bool:
        try:
            import sentence_transformers  # noqa: F401
        except ImportError:
            return False
        return True


def provider(settings: EmbeddingSettings | None = None, for_search: bool = False) -> Provider:
    """The provider that the settings name; the mock one if it isn't at hand."""
    settings = settings or EmbeddingSettings()
    chosen: Provider | None = None
    if settings.provider == "ollama":
        chosen = HttpProvider(settings, for_search)
    elif settings.provider == "huggingface":
        chosen = SentenceProvider(settings.search_model if for_search else settings.warm_model)
    if chosen is not None and chosen.available():
        return chosen
    return MockProvider(DIMENSIONS, settings.warm_model or "mock")


#: Batches that are asked for at a time, and seconds before the first of a few more tries.
AT_ONCE, TRIES, WAIT = 6, 3, 0.5


def in_batches(texts: list[str], chosen: Provider, batch: int = 64, at_once: int = AT_ONCE, tries: int = TRIES, wait: float = WAIT) -> list[list[float]]:
    """Vectors of all texts in order: ``at_once`` batches in flight, each tried again after a pause that doubles."""

    def one(some: list[str]) -> list[list[float]]:
        for n in range(tries):
            try:
                return chosen.embed_batch(some)
            except Exception:
                if n + 1 == tries:
                    raise
                time.sleep(wait * 2**n)
        return []

    parts = [texts[k : k + batch] for k in range(0, len(texts), batch)]
    if getattr(chosen, "serial", False) or len(parts) < 2:
        return [v for p in parts for v in one(p)]
    with ThreadPoolExecutor(at_once) as pool:
        return [v for found in pool.map(one, parts) for v in found]


def embedding(text: Column | str, chosen: Provider, batch: int = 64) -> Column:
    """Vectors (array of float) of a text column, ``batch`` texts a call and AT_ONCE calls at a time a task; a null text counts as empty."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(in_batches([x or "" for x in texts], chosen, batch))

    return F.pandas_udf(run, "array<float>")(text)
