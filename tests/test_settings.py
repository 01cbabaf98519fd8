"""Precedence of settings and what is refused."""

import json

import pytest

from tesserae.settings import ConfigError, load_settings


def write(root, **values):
    (root / "tesserae.json").write_text(json.dumps({f"TESSERAE_{k}": v for k, v in values.items()}))


def test_precedence(tmp_path, monkeypatch):
    assert load_settings(tmp_path).top_k == 8
    write(tmp_path, TOP_K=3, EMBEDDING_DIMENSION="16")
    assert (load_settings(tmp_path).top_k, load_settings(tmp_path).embedding.dim) == (3, 16)
    monkeypatch.setenv("TESSERAE_TOP_K", "4")
    assert load_settings(tmp_path).top_k == 4
    assert load_settings(tmp_path, top_k=5).top_k == 5


@pytest.mark.parametrize("values", [{"TOP_K": 0}, {"TOP_K": "x"}, {"TOP_K": True}, {"ODD": 1}, {"EMBEDDING_API_KEY": "s"}, {"EMBEDDING_TIMEOUT_SECONDS": "nan"}, {"EMBEDDING_MAX_RETRIES": -1}, {"INDEX_PATH": "src/index"}])
def test_refused(tmp_path, values):
    write(tmp_path, **values)
    with pytest.raises(ConfigError) as caught:
        load_settings(tmp_path)
    assert "'s'" not in str(caught.value)


def test_files(tmp_path, monkeypatch):
    (tmp_path / "tesserae.json").write_text("[1]")
    with pytest.raises(ConfigError):
        load_settings(tmp_path)
    monkeypatch.setenv("TESSERAE_CONFIG", str(tmp_path / "none.json"))
    with pytest.raises(ConfigError):
        load_settings(tmp_path)


def test_index_may_lie_outside(tmp_path):
    write(tmp_path, INDEX_PATH=str(tmp_path.parent / "elsewhere"))
    assert load_settings(tmp_path).index_path == tmp_path.parent / "elsewhere"
