"""Settings: command line, then environment, then a JSON file, then defaults. Keys of services come from the environment only."""

from __future__ import annotations

import json
import math
import os
from dataclasses import dataclass
from pathlib import Path

from tesserae.operators.embed import EmbeddingConfig

PREFIX = "TESSERAE_"
FILES = (".tesserae/config.json", "tesserae.json")
KEYS = {
    "MODEL", "ENDPOINT", "TOP_K", "MAX_CONTEXT_CHARS", "MAX_OUTPUT_TOKENS", "INDEX_PATH", "EMBEDDING_PROVIDER", "EMBEDDING_MODEL", "EMBEDDING_ENDPOINT",
    "EMBEDDING_BATCH_SIZE", "EMBEDDING_MAX_RETRIES", "EMBEDDING_RETRY_BASE_DELAY_SECONDS", "EMBEDDING_TIMEOUT_SECONDS", "EMBEDDING_DIMENSION",
}
SECRETS = {"EMBEDDING_API_KEY", "ANSWER_API_KEY"}


class ConfigError(ValueError):
    """A setting is missing, unknown or out of range."""


@dataclass(frozen=True)
class Settings:
    """What a run needs besides its data."""

    repo_root: Path
    index_path: Path
    top_k: int
    max_context_chars: int
    max_output_tokens: int
    model: str | None
    endpoint: str | None
    embedding: EmbeddingConfig
    config_file: Path | None


def find_config_file(root: Path) -> Path | None:
    """The file that ``TESSERAE_CONFIG`` names, or the first of the usual places."""
    named = os.environ.get(PREFIX + "CONFIG")
    if named:
        path = Path(named).expanduser()
        if not path.is_file():
            raise ConfigError(f"{PREFIX}CONFIG names {path}, which is no file")
        return path
    return next((root / name for name in FILES if (root / name).is_file()), None)


def read_config_file(path: Path) -> dict[str, str]:
    """Settings of a JSON file; secrets and unknown names are refused."""
    try:
        data = json.loads(path.read_text(encoding="utf-8"))
    except (OSError, ValueError) as error:
        raise ConfigError(f"{path} cannot be read as JSON: {error}") from error
    if not isinstance(data, dict):
        raise ConfigError(f"{path} must hold an object")
    out = {}
    for key, value in data.items():
        name = key.removeprefix(PREFIX)
        if name in SECRETS:
            raise ConfigError(f"{path}: {key} is a secret and belongs in the environment")
        if name not in KEYS or not key.startswith(PREFIX):
            raise ConfigError(f"{path}: unknown setting {key}")
        if isinstance(value, bool) or not isinstance(value, (str, int, float)):
            raise ConfigError(f"{path}: {key} must be a string or a number")
        out[name] = str(value)
    return out


def load_settings(root: str | Path, **overrides) -> Settings:
    """Settings of a repository; ``overrides`` stand for command line options, None for those not given."""
    root = Path(root).resolve()
    file = find_config_file(root)
    held = read_config_file(file) if file else {}

    def raw(name: str) -> str | None:
        given = overrides.get(name.lower())
        value = str(given) if given is not None else os.environ.get(PREFIX + name, held.get(name))
        return value.strip() or None if value is not None else None

    def number(name: str, default, least, kind=int):
        value = raw(name)
        if value is None:
            return default
        try:
            out = kind(value)
        except ValueError as error:
            raise ConfigError(f"{PREFIX}{name} must be a number, not {value!r}") from error
        if not math.isfinite(out) or out < least:
            raise ConfigError(f"{PREFIX}{name} must be at least {least}, not {value}")
        return out

    place = Path(raw("INDEX_PATH") or ".tesserae/index")
    index = place if place.is_absolute() else root / place
    index = index.resolve()
    if index.is_relative_to(root) and not index.is_relative_to(root / ".tesserae"):
        raise ConfigError(f"the index at {index} must lie below {root / '.tesserae'} or outside the repository")
    provider = raw("EMBEDDING_PROVIDER") or "hashed"
    embedding = EmbeddingConfig(
        provider=provider,
        model=raw("EMBEDDING_MODEL") or ("hashed-tokens" if provider == "hashed" else "default"),
        endpoint=raw("EMBEDDING_ENDPOINT"),
        dim=number("EMBEDDING_DIMENSION", 32, 1),
        batch_size=number("EMBEDDING_BATCH_SIZE", 128, 1),
        max_retries=number("EMBEDDING_MAX_RETRIES", 2, 0),
        retry_base_seconds=number("EMBEDDING_RETRY_BASE_DELAY_SECONDS", 0.5, 0.0, float),
        timeout_seconds=number("EMBEDDING_TIMEOUT_SECONDS", 30.0, 0.001, float),
        api_key=os.environ.get(PREFIX + "EMBEDDING_API_KEY"),
    )
    return Settings(root, index, number("TOP_K", 8, 1), number("MAX_CONTEXT_CHARS", 24_000, 1), number("MAX_OUTPUT_TOKENS", 8192, 1), raw("MODEL"), raw("ENDPOINT"), embedding, file)
