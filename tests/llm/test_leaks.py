"""Leaked passages against brute force: every long passage is found, altered words or not."""

import json
import random

import numpy as np

from tesserae.llm.leaks import ItemIndex, document_words, leaks, winnow, words

rng = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(400)]
ITEMS = [(i, " ".join(rng.choices(VOCABULARY, k=rng.randint(30, 80)))) for i in range(40)]


def noise(n):
    return rng.choices([f"n{i}" for i in range(300)], k=n)


def passage(text, n, altered):
    w = text.split()
    at = rng.randint(0, len(w) - n)
    out = w[at : at + n]
    for i in rng.sample(range(1, n - 1), altered):
        if out[i - 1].startswith("w") and out[i + 1].startswith("w"):
            out[i] = "changed"
    return out


def test_every_passage_is_found():
    index = ItemIndex(ITEMS)
    for n in range(300):
        key, text = rng.choice(ITEMS)
        length = rng.randint(20, 29)
        altered = rng.choice([0, 1, 2])
        found = index.leaked([*noise(30), *passage(text, length, altered), *noise(30)])
        assert key in [f[0] for f in found], n


def test_short_passages_are_not():
    index = ItemIndex(ITEMS)
    for _ in range(200):
        key, text = rng.choice(ITEMS)
        assert index.leaked([*noise(30), *passage(text, 15, 0), *noise(30)]) == []
        w = text.split()[:24]
        w[3] = w[8] = w[13] = w[18] = "changed"
        assert index.leaked(w) == []


def test_winnowing_shares_a_fingerprint():
    r = np.random.default_rng(0)
    for _ in range(200):
        shared = r.integers(0, 2**60, 3).astype(np.uint64)
        a = np.concatenate([r.integers(0, 2**60, 9).astype(np.uint64), shared, r.integers(0, 2**60, 5).astype(np.uint64)])
        b = np.concatenate([shared, r.integers(0, 2**60, 7).astype(np.uint64)])
        assert set(a[winnow(a)]) & set(b[winnow(b)])


def test_forms_of_notebooks():
    text = ITEMS[0][1]
    w = text.upper().split()
    half = len(w) // 2
    book = json.dumps({"cells": [{"cell_type": "markdown", "source": ["**" + " ".join(w[:half]) + ",\n", "<b>" + "; ".join(w[half:]) + "</b>"]}]}, indent=1)
    percent = "# %% [markdown]\n# " + "\n# ".join(w) + "\n"
    flat = "In [1]: print('''" + "\n   ...: ".join(w) + "''')\n"
    for form in (book, percent, flat, book[: len(book) - 4]):
        assert [f[0] for f in ItemIndex(ITEMS).leaked(document_words(form))] == [0]
    assert words("A_b, C-d é1") == ["a", "b", "c", "d", "é1"]


def test_table(spark):
    text = ITEMS[3][1]
    docs = spark.createDataFrame([(1, text, 0), (1, text, 0), (2, None, 0), (3, "", 0), (4, "x " * 100_000 + text, 0), (None, text, 0), (5, "nothing here", 0)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(i, t) for i, t in ITEMS] + [(3, text), (98, None), (99, "short")], "item_id bigint, text string")
    got = sorted((r.doc_id or 0, r.item_id, r.n_words) for r in leaks(docs, items).collect())
    n = len(text.split())
    assert got == [(0, 3, n), (1, 3, n), (1, 3, n), (4, 3, n)]
    assert leaks(docs.limit(0), items).count() == 0 and leaks(docs, items.limit(0)).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    import tesserae.llm.leaks as module

    monkeypatch.setattr(module, "BLOCK_CHARS", 2000)
    docs = spark.createDataFrame([(i, t) for i, t in ITEMS], "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in leaks(docs, items).collect()} == {(i, i) for i, _ in ITEMS}


def test_many_items_are_joined_by_fingerprints(spark, monkeypatch):
    """Items of several blocks give what one block gives, also for repeated rows, null ids and altered words."""
    import random

    from tesserae.llm import leaks as module

    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(15, 60)))) for i in range(120)]
    docs = []
    for d in range(300):
        body = rng.choices(vocabulary, k=80)
        for i, text in rng.sample(items, rng.choice([0, 0, 1, 2])):
            part = text.split()[:40]
            if len(part) > 25:
                part[12] = "changed"
            body[rng.randint(0, 70) : 0] = part
        docs.append((d if d else None, " ".join(body)))
    docs += docs[1:4]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} bigint, text string")
    found = lambda: sorted(tuple(-1 if x is None else x for x in r) for r in module.leaks(frame(docs, "doc_id"), frame(items, "item_id")).collect())
    wanted = found()
    monkeypatch.setattr(module, "BLOCK_CHARS", 6000)
    assert len(wanted) > 100 and found() == wanted


def test_deep_json_is_read():
    assert "inner" in document_words('{"cells": [{"cell_type": "markdown", "source": ["inner words"]}], "deep": ' + '{"a":' * 50_000)
