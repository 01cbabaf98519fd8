"""Context budget, citations and answer clients."""

import json

import pytest

from tesserae.operators.answer import TRUNCATED, AskError, HttpClient, StubClient, answer, citations, context_budget, context_text

KIND = "question_id bigint, rank int, file string, start_line int, end_line int, symbol string, language string, match string, text string"


def hits(spark, texts, **row):
    return spark.createDataFrame([(1, i + 1, row.get("file", "a.py"), 1, 2, None, "py", "vector", t) for i, t in enumerate(texts)], KIND)


def test_budget_keeps_cuts_and_stops(spark):
    kept = context_budget(hits(spark, ["a" * 500, "b" * 5000, "c" * 50]), 1000).orderBy("rank").collect()
    assert [r["rank"] for r in kept] == [1, 2]
    assert kept[0].text == "a" * 500 and kept[1].text.endswith(TRUNCATED)
    whole = context_text(context_budget(hits(spark, ["a" * 500, "b" * 5000, "c" * 50]), 1000)).collect()[0].context
    assert len(whole) == 1000


@pytest.mark.parametrize(("limit", "ranks"), [(10, []), (45, []), (60, [1]), (560, [1]), (10_000, [1, 2, 3])])
def test_budget_limits(spark, limit, ranks):
    kept = context_budget(hits(spark, ["a" * 500, "b" * 5000, "c" * 50]), limit)
    assert sorted(r["rank"] for r in kept.collect()) == ranks
    for r in context_text(kept).collect():
        assert len(r.context) <= limit


def test_header_and_sources(spark):
    rows = [(1, 1, "b.py", 3, 9, "f", "py", "symbol", "x"), (1, 2, "a.py", 1, 2, "", "", "vector", "y"), (1, 3, "b.py", 3, 9, None, None, "vector", "z"), (1, 4, None, None, None, None, None, "vector", None)]
    kept = context_budget(spark.createDataFrame(rows, KIND), 10_000)
    text = context_text(kept).collect()[0].context
    assert text == "[1] Source: b.py:L3-L9 | Symbol: f | Language: py | Match: exact symbol\nx\n\n[2] Source: a.py:L1-L2\ny\n\n[3] Source: b.py:L3-L9\nz\n\n[4] Source: unknown file\n"
    assert citations(kept).collect()[0].citations == "- [b.py:L3-L9]\n- [a.py:L1-L2]\n- [unknown file]"
    said = answer("q", kept, StubClient())
    assert said.endswith("\n\nSources:\n- [b.py:L3-L9]\n- [a.py:L1-L2]\n- [unknown file]")
    with pytest.raises(AskError):
        answer("q", kept.limit(0), StubClient())


def test_http_client(monkeypatch):
    with pytest.raises(AskError, match="ANSWER_API_KEY"):
        HttpClient("http://service.invalid", "m")
    sent = {}

    def transport(url, body, headers):
        sent.update(json.loads(body))
        return json.dumps({"content": [{"type": "text", "text": "a"}, {"type": "tool"}, {"type": "text", "text": "b "}]}).encode()

    assert HttpClient("http://service.invalid", "m", "k", transport=transport).generate("why", "ctx") == "a\nb"
    assert sent["messages"][0]["content"] == "Question:\nwhy\n\nContext:\nctx"
    for bad in (b"x", b"{}", b'{"content": []}', b'{"content": [{"type": "tool"}]}'):
        with pytest.raises(AskError):
            HttpClient("http://service.invalid", "m", "k", transport=lambda *a, bad=bad: bad).generate("q", "c")
