"""Splitting: exact spans, natural cuts, brute-force maxima, odd inputs."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm.splitting import INSIDE, StrongestCut, boundary_strengths, piece_spans, split_oversized


def points(text):
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@given(st.lists(st.integers(-1, 6), min_size=1, max_size=60), st.data())
def test_rightmost_maximum(strengths, data):
    array = np.array(strengths, np.int8)
    low = data.draw(st.integers(0, len(strengths) - 1))
    high = data.draw(st.integers(low, len(strengths) - 1))
    best = max(range(low, high + 1), key=lambda i: (strengths[i], i))
    assert StrongestCut(array, len(strengths)).query(low, high) == best


@settings(deadline=None)
@given(st.text(alphabet="ab .\n\r;,é\u0301\u200d🎉", max_size=400), st.integers(20, 60), st.integers(0, 8))
def test_pieces_cover_and_overlap(text, limit, overlap):
    spans = piece_spans(text, limit, overlap)
    assert (not spans) == (not text)
    if not text:
        return
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b in spans)
    assert all(c == b - overlap for (_, b), (c, _) in zip(spans, spans[1:]))
    rebuilt = text[spans[0][0] : spans[0][1]] + "".join(text[a + overlap : b] for a, b in spans[1:])
    assert rebuilt == text


def test_cuts_prefer_blank_lines_then_lines():
    text = "word " * 8 + "\n\n" + "word " * 5 + "\n" + "word " * 5
    (a, b), *_ = piece_spans(text, 80, 5)
    assert text[a:b].endswith("\n\n")
    assert piece_spans("x" * 100, 30, 5)[0] == (0, 30)


def test_never_inside_a_character():
    text = "e\u0301" * 50 + "\r\n" * 50
    strengths = boundary_strengths(points(text))
    assert all(strengths[i] == INSIDE for i in range(1, 100, 2))
    assert all(strengths[i] == INSIDE for i in range(101, 200, 2))


def test_very_long_text():
    text = ("a line of words.\n" * 20 + "\n") * 2000
    spans = piece_spans(text)
    assert all(b - a <= 3000 for a, b in spans) and spans[-1][1] == len(text)
    assert all(text[b - 2 : b] == "\n\n" for _, b in spans[:-1])


def test_table(spark):
    rows = [(1, "a" * 10, 0), (2, None, 0), (3, "", 0), (None, "b" * 30, 0), (4, "c d " * 20, 0), (4, "c d " * 20, 0)]
    df = spark.createDataFrame(rows, "chunk_id bigint, text string, piece int")
    got = split_oversized(df, max_chars=20, overlap=4)
    assert got.columns == ["chunk_id", "piece", "start_char", "end_char", "start_line", "text"]
    found = got.collect()
    assert {r.chunk_id for r in found} == {None, 4}
    assert sum(r.chunk_id == 4 and r.piece == 0 for r in found) == 2
    assert split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, max_chars=20, overlap=10)
