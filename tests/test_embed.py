"""Hashed embeddings, providers, batching, retries and checks."""

import json
import math

import pytest

from tesserae.operators.embed import (
    EmbeddingConfig, EmbeddingError, EmbeddingRateLimitError, EmbeddingTransientError, HashedProvider, HttpProvider, embed_texts, embed_with_retries, get_provider, hashed_vectors, with_vectors,
)

TEXTS = ["Hello, world hello", "", "!!!", "größe ist 12_a", "a a a b", "日本 語"]


def test_native_and_python_twins_agree(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r["i"]: r["vector"] for r in hashed_vectors(df, "i", "t", 48).collect()}
    for i, text in enumerate(TEXTS):
        wanted = HashedProvider(48).embed_batch([text])[0]
        assert got[i] == pytest.approx(wanted, abs=1e-12)
        assert math.isclose(sum(x * x for x in wanted), 1.0, rel_tol=1e-9)


class Flaky:
    def __init__(self, *failures):
        self.failures, self.calls = list(failures), 0

    def embed_batch(self, texts):
        self.calls += 1
        if self.failures:
            raise self.failures.pop(0)
        return [[1.0, 0.0] for _ in texts]


def test_retries_double_the_pause():
    pauses = []
    provider = Flaky(EmbeddingRateLimitError("wait"), EmbeddingTransientError("again"))
    assert embed_with_retries(provider, ["a"], EmbeddingConfig(), pauses.append) == [[1.0, 0.0]]
    assert pauses == [0.5, 1.0]


@pytest.mark.parametrize("failure", [EmbeddingRateLimitError("x"), EmbeddingTransientError("x")])
def test_type_survives_the_last_try(failure):
    provider = Flaky(*[failure] * 3)
    with pytest.raises(type(failure)):
        embed_with_retries(provider, ["a"], EmbeddingConfig(), lambda s: None)
    assert provider.calls == 3


def test_fatal_errors_are_not_tried_again():
    provider = Flaky(EmbeddingError("no"))
    with pytest.raises(EmbeddingError, match="no"):
        embed_with_retries(provider, ["a"], EmbeddingConfig(), lambda s: None)
    assert provider.calls == 1
    with pytest.raises(EmbeddingError, match="boom"):
        embed_with_retries(Flaky(KeyError("boom")), ["a"], EmbeddingConfig(), lambda s: None)


def test_batches_and_counts():
    seen = []

    class Counting:
        def embed_batch(self, texts):
            seen.append(len(texts))
            return [[0.0]] * len(texts)

    assert len(embed_texts(["x"] * 5, EmbeddingConfig(batch_size=2), Counting())) == 5
    assert seen == [2, 2, 1]

    class Short:
        def embed_batch(self, texts):
            return []

    with pytest.raises(EmbeddingError):
        embed_texts(["x"], EmbeddingConfig(), Short())


def response(items):
    return lambda url, body, headers, timeout: json.dumps({"data": items}).encode()


def test_http_provider_orders_and_checks():
    config = EmbeddingConfig(provider="http", endpoint="http://service.invalid", api_key="k")
    good = HttpProvider(config, response([{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]))
    assert good.embed_batch(["a", "b"]) == [[1.0], [2.0]]
    for items in ([{"index": 0, "embedding": [1]}], [{"index": 0, "embedding": [1]}, {"index": 0, "embedding": [1]}], [{"index": 0, "embedding": ["x"]}, {"index": 1, "embedding": [1]}], "x"):
        with pytest.raises(EmbeddingError):
            HttpProvider(config, response(items)).embed_batch(["a", "b"])
    with pytest.raises(EmbeddingError):
        HttpProvider(EmbeddingConfig(provider="http"))


def test_key_is_not_shown():
    assert "hidden" not in repr(EmbeddingConfig(api_key="hidden"))
    with pytest.raises(ValueError):
        get_provider(EmbeddingConfig(provider="none"))


def test_provider_through_arrow(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "id int, text string")
    native = {r["id"]: r["vector"] for r in with_vectors(df, "id", "text", EmbeddingConfig(dim=16)).collect()}
    assert set(native) == {1, 2} and all(len(v) == 16 for v in native.values())
