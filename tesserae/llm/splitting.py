"""Splitting oversized items at natural boundaries.

Each position of a text between two characters has a boundary strength. A sparse table over the
strengths answers "the strongest cut in this window, the rightmost of equals" in constant time; a
piece ends at that cut, and the next one starts ``overlap`` characters before it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS = 3000
OVERLAP = 200
#: Positions that one sparse table covers; bounds memory for texts of any length.
SLAB = 1 << 16

# Boundary strengths.
INSIDE, ANYWHERE, SPACE, CLAUSE, SENTENCE, LINE, DEDENT, BLANK = -1, 0, 1, 2, 3, 4, 5, 6

_SPACES = np.array([9, 11, 12, 32, 0xA0, 0x3000, *range(0x2000, 0x200B)], dtype=np.uint32)
_ENDS = np.array([ord(c) for c in ".!?…。!?;}"], dtype=np.uint32)
_CLAUSES = np.array([ord(c) for c in ",:)]>、,"], dtype=np.uint32)
_QUOTES = np.array([ord(c) for c in "\"')]»”’"], dtype=np.uint32)


def boundary_strengths(points: np.ndarray) -> np.ndarray:
    """Strength of a cut before each code point of ``points`` (uint32).

    A cut never parts CR from LF, a combining mark or joiner from its base. A cut behind a line
    break is stronger if the next line is less indented than the last one, and strongest behind a
    blank line.
    """
    n = len(points)
    out = np.zeros(n, dtype=np.int8)
    if n == 0:
        return out
    before = points[:-1]
    newline = (points == 10) | ((points == 13) & np.append(points[1:] != 10, True))
    space = np.isin(points, _SPACES)
    here = out[1:]
    here[space[:-1]] = SPACE
    quoted = np.isin(before, _QUOTES)
    closes = np.isin(before, _CLAUSES)
    ends = np.isin(before, _ENDS)
    if n > 2:
        ends[1:] |= quoted[1:] & np.isin(points[:-2], _ENDS)
        after_space = space[1:-1]
        here[1:][after_space & closes[:-1]] = CLAUSE
        here[1:][after_space & ends[:-1]] = SENTENCE
    wide = before >= 0x3000  # scripts without spaces end their sentences without one
    here[wide & closes] = CLAUSE
    here[wide & ends] = SENTENCE
    here[newline[:-1]] = LINE
    # Indentation and blankness of each line, to grade the cuts between lines.
    starts = np.flatnonzero(np.append(True, newline[:-1]))
    bound = np.append(starts[1:], n)
    ink = np.flatnonzero(~(space | newline | (points == 13)))
    first = np.searchsorted(ink, starts)
    blank = (first >= len(ink)) | (np.append(ink, n)[np.minimum(first, len(ink))] >= bound)
    indent = np.where(blank, 0, np.append(ink, n)[np.minimum(first, len(ink))] - starts)
    if len(starts) > 1:
        cuts = starts[1:]
        strength = np.full(len(cuts), LINE, dtype=np.int8)
        strength[(indent[1:] < indent[:-1]) & ~blank[1:]] = DEDENT
        strength[blank[:-1]] = BLANK
        strength[blank[1:]] = LINE
        out[cuts] = strength
    inside = (points >= 0x300) & (
        (points <= 0x36F) | ((points >= 0xFE00) & (points <= 0xFE0F)) | (points == 0x200D)
        | ((points >= 0x1AB0) & (points <= 0x1AFF)) | ((points >= 0x20D0) & (points <= 0x20FF))
        | ((points >= 0x1F3FB) & (points <= 0x1F3FF))
    )
    odd = np.flatnonzero((points > 0x36F) & ~inside)
    if len(odd):
        kinds = {p: unicodedata.combining(chr(p)) != 0 for p in set(points[odd].tolist()) if p < 0xD800 or 0xDFFF < p < 0x110000}
        inside[odd] = [kinds.get(p, False) for p in points[odd].tolist()]
    inside[1:] |= points[:-1] == 0x200D
    inside[1:] |= (points[:-1] == 13) & (points[1:] == 10)
    out[inside] = INSIDE
    return out


class StrongestCut:
    """Sparse table for the rightmost maximum of a range of boundary strengths."""

    def __init__(self, strengths: np.ndarray, widest: int):
        self._strengths = strengths
        level = np.arange(len(strengths), dtype=np.int32)
        self._levels = [level]
        step = 1
        while 2 * step <= min(widest, len(strengths)):
            left, right = level[:-step], level[step:]
            level = np.where(strengths[right] >= strengths[left], right, left)
            self._levels.append(level)
            step *= 2

    def query(self, low: int, high: int) -> int:
        """Position of the rightmost maximum in ``[low, high]``."""
        k = (high - low + 1).bit_length() - 1
        left = int(self._levels[k][low])
        right = int(self._levels[k][high - (1 << k) + 1])
        return right if self._strengths[right] >= self._strengths[left] else left


def piece_spans(text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Code point spans of the pieces of ``text``.

    A text within the limit is one piece; an empty one gives none. Every piece has at most
    ``max_chars`` characters and starts exactly ``overlap`` characters before the end of the one
    before it, whatever the text; a text without any boundary is cut at the limit.
    """
    n = len(text)
    if n == 0:
        return []
    spans, start = [], 0
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    least = max(overlap + 1, max_chars // 2)
    base, index = 0, None
    while n - start > max_chars:
        if index is None or start + max_chars >= base + size:
            base = start
            size = min(max(SLAB, 4 * max_chars), n - base)
            lead = min(base, max_chars)  # the line before a cut counts for its strength
            strengths = boundary_strengths(points[base - lead : base + size + 1])[lead : lead + size + 1]
            index = StrongestCut(strengths, max_chars - least + 1)
        end = base + index.query(start + least - base, start + max_chars - base)
        spans.append((start, end))
        start = end - overlap
    spans.append((start, n))
    return spans


def split_oversized(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the rows of ``df`` whose text has more than ``max_chars`` code points.

    Result: ``id_col`` as in ``df``, ``piece`` (from 0), ``start_char``, ``end_char`` (code points,
    end exclusive), ``start_line`` (from 1, counted in the item), ``text``. Rows with a null, an
    empty or a short text give no piece; a row that comes twice gives its pieces twice; a null id
    is kept. Other columns of ``df``, whatever their names, are not read.
    """
    if max_chars < 2 or overlap < 0 or overlap + 1 > max_chars // 2:
        raise ValueError("overlap must be less than half of max_chars")
    kind = df.schema[id_col].dataType.simpleString()
    long = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.length("text") > max_chars)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(*(batch.column(c).to_pylist() for c in ("id", "text"))):
                line, seen = 1, 0
                for piece, (a, b) in enumerate(piece_spans(text, max_chars, overlap)):
                    line += text.count("\n", seen, a)
                    seen = a
                    rows.append((key, piece, a, b, line, text[a:b]))
            columns = list(zip(*rows)) or [()] * 6
            types = [batch.schema.field("id").type, pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "piece", "start_char", "end_char", "start_line", "text"])

    schema = f"id {kind}, piece int, start_char bigint, end_char bigint, start_line int, text string"
    out = long.mapInArrow(cut, schema)
    return out.withColumnRenamed("id", id_col)
