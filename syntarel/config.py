"""Settings of a project, kept as JSON in its folder."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from .sources.rules import PROJECT_FOLDER


# Names of embedding providers.
PROVIDERS = ("mock", "ollama", "huggingface")


@dataclass
class EmbeddingSettings:
    provider: str = "mock"
    warm_model: str = "nomic-embed-text-v2-moe"
    search_model: str = "embeddinggemma"
    base_url: str = "http://localhost:11434"
    api_key: str | None = None


@dataclass
class Settings:
    embeddings: EmbeddingSettings = field(default_factory=EmbeddingSettings)


def load(project: str) -> Settings:
    """The project's settings over the defaults; a missing or invalid file gives the defaults."""
    try:
        given = json.loads((Path(project) / PROJECT_FOLDER / "config.json").read_text())["embeddings"]
        known = {f.name for f in fields(EmbeddingSettings)}
        return Settings(EmbeddingSettings(**{k: v for k, v in given.items() if k in known}))
    except (OSError, ValueError, KeyError, TypeError, AttributeError):
        return Settings()


def save(project: str, settings: Settings) -> None:
    folder = Path(project) / PROJECT_FOLDER
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "config.json").write_text(json.dumps(asdict(settings), indent=2))


def changed(settings: Settings, values: dict[str, str]) -> Settings:
    """The settings with some of them replaced; an empty value stands for the default. ValueError for unknown names or providers."""
    names = {f.name for f in fields(EmbeddingSettings)}
    if unknown := set(values) - names:
        raise ValueError(", ".join(sorted(unknown)))
    new = asdict(settings.embeddings) | {k: v or getattr(EmbeddingSettings(), k) for k, v in values.items()}
    if new["provider"] not in PROVIDERS:
        raise ValueError(f"provider {new['provider']}")
    return Settings(EmbeddingSettings(**new))


def asked(settings: Settings, ask: Callable[[str], str] = input) -> dict[str, str]:
    """The answers to a question for every setting that are not empty; those keep what is there."""
    answers = {f.name: ask(f"{f.name} [{getattr(settings.embeddings, f.name) or ''}]: ").strip() for f in fields(EmbeddingSettings)}
    return {k: v for k, v in answers.items() if v}
