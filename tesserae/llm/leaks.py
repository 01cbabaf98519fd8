"""Evaluation texts leaking into training text.

Winnowing: of every ``window`` consecutive k-grams of words, the one with the least hash is a
fingerprint. Two texts that share ``window + K - 1`` words in a row share a fingerprint. A passage of
20 words with two altered ones has six unaltered words in a row, so with K = 4 and a window of 3 no
such passage is missed. Shared fingerprints are extended in both directions over altered words.

The evaluation items are the query set. While they fit one block of bounded size, every document is held
against them where it is read, and no fingerprint of the corpus is moved. More items are taken in
blocks: the fingerprints of all documents that may be among those of the items, by a filter of fixed size, are
joined to them once, and each block sees only the documents that share a fingerprint with one of its items.
"""

from __future__ import annotations

import functools
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import notebooks
from tesserae.plans.runtime import cut, spread

K, WINDOW = 4, 3
LEAST_WORDS = 20
ALTERED = 0.1
#: Characters of items in a block; bounds what a task holds besides its documents.
BLOCK_CHARS = 16 << 20
#: Bits of the filter of item fingerprints, as a power of 2.
FILTER_BITS = 26

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Lower-case words without punctuation."""
    return _WORD.findall(text.lower())


def document_words(text: str) -> list[str]:
    """Words of a notebook text in order, without its markup."""
    return words("\n".join(notebooks.plain(c.text) for c in notebooks.cells(text)))


def _grams(ids: np.ndarray) -> np.ndarray:
    """Hashes of the k-grams of word ids; a gram with an unknown word (-1) has the largest hash."""
    if len(ids) < K:
        return np.empty(0, np.uint64)
    h = np.zeros(len(ids) - K + 1, np.uint64)
    known = np.ones(len(h), bool)
    for j in range(K):
        part = ids[j : len(ids) - K + 1 + j]
        h = (h ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        known &= part >= 0
    h[~known] = np.iinfo(np.uint64).max
    return h


def winnow(grams: np.ndarray) -> np.ndarray:
    """Positions of the fingerprints: the rightmost least hash of each window."""
    n = len(grams)
    if n == 0:
        return np.empty(0, np.int64)
    if n < WINDOW:
        return np.array([n - 1 - int(grams[::-1].argmin())])
    views = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    return np.unique(np.arange(n - WINDOW + 1) + WINDOW - 1 - views[:, ::-1].argmin(axis=1))


class ItemIndex:
    """Fingerprints of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.items = []
        hashes, owners, places = [], [], []
        for key, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)], np.int64)
            if len(ids) < LEAST_WORDS:
                continue
            grams = _grams(ids)
            at = winnow(grams)
            hashes.append(grams[at])
            owners.append(np.full(len(at), len(self.items)))
            places.append(at)
            self.items.append((key, ids))
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes = self.hashes[order]
        self.owners = np.concatenate(owners)[order] if owners else np.empty(0, np.int64)
        self.places = np.concatenate(places)[order] if places else np.empty(0, np.int64)

    def leaked(self, found: list[str]) -> list[tuple[int, int, int, int]]:
        """(item, first word in the document, words of the item, altered words) of the longest passage of each item found."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in found), np.int64, len(found))
        if np.count_nonzero(ids >= 0) < LEAST_WORDS * (1 - ALTERED) or not len(self.hashes):
            return []
        grams = _grams(ids)
        at = winnow(grams)
        left, right = np.searchsorted(self.hashes, grams[at], "left"), np.searchsorted(self.hashes, grams[at], "right")
        hit = np.flatnonzero((right > left) & (grams[at] != np.iinfo(np.uint64).max))
        seeds = defaultdict(list)
        for i in hit:
            for j in range(left[i], right[i]):
                seeds[int(self.owners[j])].append((int(at[i]), int(self.places[j])))
        out = []
        for owner, places in seeds.items():
            key, item = self.items[owner]
            best = _longest(ids, item, places)
            if best:
                out.append((key, *best))
        return out


def _run(a: np.ndarray, b: np.ndarray, i: int, j: int, step: int) -> int:
    """Length of the equal run of a from i and b from j in direction ``step``."""
    n = 0
    while 0 <= i < len(a) and 0 <= j < len(b) and a[i] == b[j]:
        n, i, j = n + 1, i + step, j + step
    return n


#: What one altered word can be: another word, one for two or two for one (hyphens), one more or one less.
_EDITS = ((1, 1), (1, 2), (2, 1), (2, 2), (0, 1), (1, 0))


def _extend(a: np.ndarray, b: np.ndarray, i: int, j: int, step: int) -> list[tuple[int, int, int]]:
    """(run, words of a, words of b in the altered place before it) of the runs from (i, j) on, the first without such a place."""
    out, skipped = [], (0, 0)
    while True:
        n = _run(a, b, i, j, step)
        out.append((n, *skipped))
        i, j = i + step * n, j + step * n
        ways = [(_run(a, b, i + step * x, j + step * y, step), -max(x, y), x, y) for x, y in _EDITS]
        n, _, x, y = max(ways)
        if n < (1 if (x, y) == (1, 1) else 3):
            return out
        i, j, skipped = i + step * x, j + step * y, (x, y)


def _longest(doc: np.ndarray, item: np.ndarray, places: list[tuple[int, int]]) -> tuple[int, int, int] | None:
    """(first word, words of the item, altered words) of the longest passage through one of the places."""
    best, seen = None, set()
    for i, j in places:
        if any(d == i - j and a <= i < b for d, a, b in seen):
            continue
        ahead, back = _extend(doc, item, i, j, 1), _extend(doc, item, i - 1, j - 1, -1)
        # Runs in reading order, with the altered place before each but the first.
        runs = [(n, x, y) for (n, *_), (_, x, y) in zip(reversed(back), [(0, 0, 0), *reversed(back[1:])])]
        runs[-1] = (runs[-1][0] + ahead[0][0], *runs[-1][1:])
        runs += ahead[1:]
        first = i - sum(n for n, *_ in back) - sum(x for _, x, _ in back)
        seen.add((i - j, i - back[0][0], i + ahead[0][0]))
        start = first
        for s, (n, *_) in enumerate(runs):
            covered, changed = n, 0
            if s:
                start += runs[s - 1][0] + runs[s][1]
            for e in range(s, len(runs)):
                if e > s:
                    covered, changed = covered + runs[e][0] + runs[e][2], changed + 1
                if covered >= LEAST_WORDS and changed <= ALTERED * covered and (best is None or covered > best[1]):
                    best = (start, covered, changed)
    return best


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id``, ``item_id``, ``first_word``, ``n_words``, ``n_altered``: items found in documents.

    One row for each document row and item, for the longest passage. Null or empty texts hold and
    give nothing, nor do items of fewer than 20 words; null ids are kept; of repeated item rows one
    counts. Only the four named columns are read.
    """
    query = items.select(F.col(item_id).cast("bigint").alias("id"), F.col(item_text).alias("text")).filter(F.length("text") > 0).distinct()
    size = query.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(size / BLOCK_CHARS))
    rows = spread(docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(doc_text).alias("text")).filter(F.length("text") > 0))
    block = F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) if blocks > 1 else F.lit(0)
    near = _candidates(rows, query.withColumn("block", block)) if blocks > 1 else None
    found = None
    for n in range(blocks):
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex([(r["id"], r["text"]) for r in query.filter(block == n).orderBy("id", "text").collect()]))

        def find(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                    out += [(key, *hit) for hit in index.value.leaked(document_words(text))]
                columns = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.int32()] * 2)], names=["doc_id", "item_id", "first_word", "n_words", "n_altered"])

        some = rows if near is None else rows.join(near.filter(F.col("block") == n).select("k"), F.xxhash64("id", "text") == F.col("k"), "left_semi")
        part = some.mapInArrow(find, "doc_id bigint, item_id bigint, first_word bigint, n_words int, n_altered int")
        found = part if found is None else found.unionByName(part)
    return found


@functools.lru_cache(maxsize=1 << 18)
def _word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word) >> 1


def _fingerprints(found: list[str]) -> np.ndarray:
    """Distinct fingerprints of a text, the same whatever other texts there are."""
    grams = _grams(np.fromiter(map(_word_hash, found), np.int64, len(found)))
    return np.unique(grams[winnow(grams)])


def _slot(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and bit of each fingerprint in the filter."""
    bit = prints >> np.uint64(64 - FILTER_BITS)
    return (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63))


def _candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``k``, ``block``: documents, by the hash of id and text, that share a fingerprint with an item of a block."""

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [_fingerprints(words(t)) for t in batch.column("text").to_pylist()]
            owners = np.repeat(np.arange(len(prints)), [len(p) for p in prints])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *prints]).view(np.int64)), batch.column("block").take(pa.array(owners))], names=["h", "block"])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, bit = _slot(batch.column("h").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bit.view(np.int64))], names=["at", "bit"])

    prints = cut(spread(items.select("text", F.col("block").cast("int").alias("block"))).mapInArrow(of_items, "h bigint, block int").distinct())
    table = prints.select("h").mapInArrow(bits, "at bigint, bit bigint").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    mask = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    mask[table.column("at").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(mask)

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                own = _fingerprints(document_words(text))
                at, bit = _slot(own)
                found.append(own[(shared.value[at] & bit) != 0].view(np.int64))
            owners = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(owners)), pa.array(np.concatenate([np.empty(0, np.int64), *found]))], names=["k", "h"])

    asked = docs.select(F.xxhash64("id", "text").alias("k"), "text").mapInArrow(of_docs, "k bigint, h bigint")
    return cut(asked.join(prints, "h").select("k", "block").distinct())
