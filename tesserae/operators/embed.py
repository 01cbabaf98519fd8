"""Embeddings: the hashed bag of tokens in the JVM, and providers behind an Arrow function."""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.columns import tokens

DEFAULT_DIM = 32


class EmbeddingError(RuntimeError):
    """An embedding request failed for good."""


class EmbeddingRateLimitError(EmbeddingError):
    """The provider asks to wait."""


class EmbeddingTransientError(EmbeddingError):
    """A failure that may pass."""


@dataclass(frozen=True)
class EmbeddingConfig:
    """How to reach a provider; the key is not shown."""

    provider: str = "hashed"
    model: str = "hashed-tokens"
    endpoint: str | None = None
    dim: int = DEFAULT_DIM
    batch_size: int = 128
    max_retries: int = 2
    retry_base_seconds: float = 0.5
    timeout_seconds: float = 30.0
    api_key: str | None = field(default=None, repr=False)


class EmbeddingProvider(Protocol):
    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        """One vector for each text, in order."""


def _byte(digest: Column, n: int) -> Column:
    return F.conv(F.substring(digest, 2 * n + 1, 2), 16, 10).cast("int")


def slot_sums(df: DataFrame, key: str, text: str, dim: int = DEFAULT_DIM) -> DataFrame:
    """``key``, ``slot``, ``value``: the sums of the hashed bag of tokens before normalisation.

    Counts of a token in a text come first, so each distinct token of a text is hashed once; sums are
    partial before the exchange.
    """
    words = df.select(F.col(key), F.explode(tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))
    digest = F.sha2("token", 256)
    sign = F.when(_byte(digest, 1) % 2 == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    value = F.col("n") * sign * (1 + _byte(digest, 2) / 255)
    return words.select(key, F.pmod(_byte(digest, 0), F.lit(dim)).alias("slot"), value.alias("value")).groupBy(key, "slot").agg(F.sum("value").alias("value"))


def hashed_vectors(df: DataFrame, key: str, text: str, dim: int = DEFAULT_DIM) -> DataFrame:
    """``key``, ``vector``: unit vectors of the hashed bag of tokens; one without length stays zero."""
    entry = F.map_from_entries(F.collect_list(F.struct("slot", "value")))
    rows = slot_sums(df, key, text, dim).groupBy(key).agg(entry.alias("m"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    length = F.when(F.col("norm") == 0, F.lit(1.0)).otherwise(F.col("norm"))
    return rows.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / length).alias("vector"))


class HashedProvider:
    """The hashed bag of tokens without Spark; the twin of :func:`hashed_vectors`."""

    def __init__(self, dim: int = DEFAULT_DIM):
        if dim <= 0:
            raise ValueError("the dimension must be positive")
        self.dim = dim

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [self._embed(t) for t in texts]

    def _embed(self, text: str) -> list[float]:
        out = [0.0] * self.dim
        for token in re.findall(r"\w+", text.lower()) or [text]:
            digest = hashlib.sha256(token.encode("utf-8")).digest()
            out[digest[0] % self.dim] += (-1.0 if digest[1] % 2 else 1.0) * (1 + digest[2] / 255)
        length = math.sqrt(sum(x * x for x in out))
        return [x / length for x in out] if length else out


class HttpProvider:
    """A JSON embedding service: ``{"input": [...], "model": ...}`` to ``{"data": [{"index", "embedding"}]}``."""

    def __init__(self, config: EmbeddingConfig, transport: Callable[[str, bytes, dict, float], bytes] | None = None):
        if not config.endpoint:
            raise EmbeddingError("the provider needs an endpoint")
        self._config = config
        self._transport = transport or _post

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        c = self._config
        headers = {"content-type": "application/json"} | ({"authorization": f"Bearer {c.api_key}"} if c.api_key else {})
        raw = self._transport(c.endpoint, json.dumps({"input": texts, "model": c.model}).encode(), headers, c.timeout_seconds)
        try:
            data = json.loads(raw)["data"]
            by_index = {item["index"]: item["embedding"] for item in data}
        except (ValueError, KeyError, TypeError) as error:
            raise EmbeddingError("the response is not a list of embeddings") from error
        if sorted(by_index) != list(range(len(texts))) or len(data) != len(texts):
            raise EmbeddingError(f"{len(texts)} texts were sent, the response holds indexes {sorted(by_index)}")
        out = [by_index[i] for i in range(len(texts))]
        if any(not isinstance(v, list) or not v or not all(isinstance(x, (int, float)) and math.isfinite(x) for x in v) for v in out):
            raise EmbeddingError("an embedding is not a list of finite numbers")
        return [[float(x) for x in v] for v in out]


def _post(url: str, body: bytes, headers: dict, timeout: float) -> bytes:
    request = urllib.request.Request(url, data=body, method="POST", headers=headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as response:
            return response.read()
    except urllib.error.HTTPError as error:
        kind = EmbeddingRateLimitError if error.code == 429 else EmbeddingTransientError if error.code >= 500 else EmbeddingError
        raise kind(f"the embedding request failed with HTTP {error.code}") from error
    except (urllib.error.URLError, TimeoutError, ConnectionError) as error:
        raise EmbeddingTransientError(f"the embedding request failed: {error}") from error


PROVIDERS: dict[str, Callable[[EmbeddingConfig], EmbeddingProvider]] = {"hashed": lambda c: HashedProvider(c.dim), "http": HttpProvider}


def get_provider(config: EmbeddingConfig) -> EmbeddingProvider:
    """The provider a configuration names."""
    if config.provider not in PROVIDERS:
        raise ValueError(f"unknown embedding provider {config.provider!r}; known: {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[config.provider](config)


def embed_with_retries(provider: EmbeddingProvider, texts: list[str], config: EmbeddingConfig, sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """One batch; rate limits and passing failures are tried again with doubling pauses, and keep their type at the end."""
    for attempt in range(config.max_retries + 1):
        try:
            return provider.embed_batch(texts)
        except (EmbeddingRateLimitError, EmbeddingTransientError):
            if attempt == config.max_retries:
                raise
            sleep(config.retry_base_seconds * 2**attempt)
        except EmbeddingError:
            raise
        except Exception as error:
            raise EmbeddingError(f"the embedding provider failed: {error}") from error
    raise AssertionError("unreachable")


def embed_texts(texts: list[str], config: EmbeddingConfig, provider: EmbeddingProvider | None = None, sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """Vectors of texts in batches; their number and size are checked."""
    provider = provider or get_provider(config)
    out: list[list[float]] = []
    for i in range(0, len(texts), config.batch_size):
        batch = texts[i : i + config.batch_size]
        vectors = embed_with_retries(provider, batch, config, sleep)
        if len(vectors) != len(batch):
            raise EmbeddingError(f"{len(batch)} texts gave {len(vectors)} vectors")
        out += vectors
    if len({len(v) for v in out}) > 1:
        raise EmbeddingError("the vectors differ in size")
    return out


def with_vectors(df: DataFrame, key: str, text: str, config: EmbeddingConfig, isolate: str | None = None) -> DataFrame:
    """``df`` with a ``vector`` column: in the JVM for the hashed provider, else through Arrow batches on the executors.

    With ``isolate``, the name of a column, a batch that fails is tried again group by group of that
    column; the rows of a group that fails have a null vector and ``embed_error``, which is null elsewhere.

    The provider's key is read from ``TESSERAE_EMBEDDING_API_KEY`` on the executors and is never part
    of the plan.
    """
    if config.provider == "hashed":
        rows = df.join(hashed_vectors(df.select(key, text), key, text, config.dim), key)
        return rows.withColumn("embed_error", F.lit(None).cast("string")) if isolate else rows
    from dataclasses import replace

    from tesserae.plans.runtime import ensure_importable

    ensure_importable(df.sparkSession)
    plain = replace(config, api_key=None)

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = replace(plain, api_key=os.environ.get("TESSERAE_EMBEDDING_API_KEY"))
        provider = get_provider(held)
        for batch in batches:
            texts, errors = batch.column(text).to_pylist(), [None] * batch.num_rows
            try:
                vectors = embed_texts(texts, held, provider)
            except EmbeddingError:
                if not isolate:
                    raise
                vectors, errors = _by_group(texts, batch.column(isolate).to_pylist(), held, provider)
            more = [pa.array(errors, pa.string())] if isolate else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float64())), *more], names=[*batch.schema.names, "vector", *(["embed_error"] if isolate else [])])

    from pyspark.sql import types as T

    added = [T.StructField("vector", T.ArrayType(T.DoubleType())), *([T.StructField("embed_error", T.StringType())] if isolate else [])]
    return df.mapInArrow(embed, T.StructType([*df.schema.fields, *added]))


def _by_group(texts: list[str], groups: list, config: EmbeddingConfig, provider: EmbeddingProvider) -> tuple[list, list]:
    """Vectors and errors of texts, each group on its own."""
    vectors, errors = [None] * len(texts), [None] * len(texts)
    for group in dict.fromkeys(groups):
        rows = [i for i, g in enumerate(groups) if g == group]
        try:
            for i, vector in zip(rows, embed_texts([texts[i] for i in rows], config, provider)):
                vectors[i] = vector
        except EmbeddingError as error:
            for i in rows:
                errors[i] = str(error)
    return vectors, errors
