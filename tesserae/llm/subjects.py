"""Subject area of each document.

For each subject an interpolated bigram model of words is trained on sentences of labelled documents;
a background model has the counts of the whole corpus. A sentence is of the subject whose model saves
most against the background, if it saves enough; a document is about a subject that has enough of
its sentences and whose cross-entropy over them, per token, is far enough below the background's. All of these
thresholds are calibrated by folds: on labelled documents whose labels the models did not see.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.llm import notebooks
from tesserae.plans.runtime import cut, spread

#: Labelled documents that the models are fitted on, at most, and their words.
LABELLED = 4000
LABELLED_WORDS = 4_000_000
#: Parts of the labelled documents for calibration.
FOLDS = 3
#: Interpolation weights of bigram, unigram and background.
BIGRAM, UNIGRAM, BACKGROUND = 0.45, 0.40, 0.15
#: Taken off every count of a subject.
DISCOUNT = 0.9
ROUNDS = 4
#: Natural units that a sentence must save to be of a subject while models are fitted.
LEAST_GAIN = 2.5

_SENTENCE = re.compile(r"(?<=[.!?:])\s+|\n\s*\n|\n(?=[#*\-])")
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_COLUMN = re.compile(r"['\"]([A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)*)['\"]")
_BLANK = re.compile(r"\n\s*\n")
_HEADER = re.compile(r"^\s*+((?:[A-Za-z]\w*+\s++)+[A-Za-z]\w*+)\s*$", re.M)


def sentences(text: str | None) -> tuple[list[tuple[str, ...]], list[tuple[str, ...]]]:
    """Sentences of the prose, and the names of data columns cell by cell, each as words."""
    prose, columns = [], []
    if not text:
        return prose, columns
    for cell in notebooks.cells(text):
        if cell.kind == notebooks.MARKDOWN:
            for sentence in _SENTENCE.split(notebooks.plain(cell.text)):
                found = tuple(w.lower() for w in _WORD.findall(sentence))
                if found:
                    prose.append(found)
        else:
            names = _COLUMN.findall(cell.text) if cell.kind == notebooks.CODE else [n for line in _HEADER.findall(_BLANK.sub("\n", cell.text)) for n in line.split()]
            names = tuple(sorted({"=" + n.lower() for n in names}))
            if names:
                columns.append(names)
    return prose, columns


def grams(sentence: tuple[str, ...]) -> Iterator:
    """Words and adjacent pairs; names of columns stand in no order and form no pairs."""
    last = None
    for w in sentence:
        yield w
        if last is not None and not w.startswith("="):
            yield last, w
        last = w


class Models:
    """Interpolated bigram models of the subjects against the background, as a table of log ratios.

    A row of the table has, for a word after a word, what each subject saves. Pairs that no subject
    has seen fall back to the word's row, words that none has seen to zeros.
    """

    def __init__(self, names: list[str], sums: dict[str, Counter], background: Counter, total: float):
        self.names = names
        self.rows: dict = {}
        floor = 1 / (max(total, 1.0) + len(background) + 1)
        table: dict = defaultdict(lambda: np.zeros(len(names)))
        for k, s in enumerate(names):
            for gram, c in sums[s].items():
                # One count less for what was seen once: a word of one document says little.
                table[gram][k] = max(c - DISCOUNT, 0.0)
        words = {g: c for g, c in table.items() if isinstance(g, str)}
        size = sum(words.values(), np.zeros(len(names))) + 1
        share = {w: c / size for w, c in words.items()}
        heads: dict = defaultdict(lambda: np.ones(len(names)))
        for g, c in table.items():
            if not isinstance(g, str):
                heads[g[0]] = heads[g[0]] + c
        matrix = [np.zeros(len(names))]
        for g, c in table.items():
            w = g if isinstance(g, str) else g[1]
            rest = (background[w] + 1) * floor
            if isinstance(g, str):
                p, back = UNIGRAM * share[w] + BACKGROUND * rest, (UNIGRAM + BACKGROUND) * rest
            else:
                after = background[g] / (background[g[0]] + 1)
                back = BIGRAM * after + (1 - BIGRAM) * rest
                p = BIGRAM * c / heads[g[0]] + UNIGRAM * share.get(w, 0.0) + BACKGROUND * back
            self.rows[g] = len(matrix)
            matrix.append(np.log(p / back))
        self.matrix = np.array(matrix, np.float32)

    def gains(self, sentences: list[tuple[str, ...]]) -> np.ndarray:
        """What each subject's model saves over each sentence, in natural units."""
        get, rows, starts = self.rows.get, [], []
        for sentence in sentences:
            starts.append(len(rows))
            last = None
            for w in sentence:
                i = get((last, w)) if last is not None else None
                rows.append(i if i is not None else get(w, 0))
                last = w
        return np.add.reduceat(self.matrix[rows], starts, axis=0) if rows else np.zeros((0, len(self.names)), np.float32)


class Acceptance(NamedTuple):
    """What a subject needs: sentences that save ``gain`` natural units each and ``per_token`` on average; a second one also ``least`` sentences and ``share`` times those of the first."""

    gain: float = LEAST_GAIN
    per_token: float = 0.0
    least: int = 2
    share: float = 0.25


#: Thresholds that are tried, one after the other with the rest as found so far.
_TRIED = {"gain": (1.5, 2.0, 2.5, 3.0, 3.5), "share": (0.2, 0.25, 0.3, 0.35, 0.4), "least": (2, 3), "per_token": (0.0, 0.1, 0.2, 0.3)}


class Scored(NamedTuple):
    """What each subject saves over each sentence, and the sentences' lengths."""

    gains: np.ndarray
    tokens: np.ndarray

    @classmethod
    def of(cls, models: Models, sentences: list) -> Scored:
        return cls(models.gains(sentences), np.fromiter(map(len, sentences), np.int64, len(sentences)))


def judge(names: list[str], prose: Scored, columns: Scored, accept: Acceptance) -> list[tuple[str, int, float]]:
    """(subject, sentences, natural units saved per token) of the one or two subjects of a document.

    Sentences are counted twice: first those that are of a subject by themselves, then also weaker
    ones of the subjects found. Data columns count only if no sentence of the prose has a subject.
    """
    for (gains, tokens), first, second in ((prose, accept.gain, accept.gain / 2), (columns, accept.gain / 2, accept.gain / 4)):
        if not len(gains):
            continue
        top, most = gains.argmax(axis=1), gains.max(axis=1)
        strong = np.bincount(top[most >= first], minlength=len(names))
        if gains is columns.gains and not strong.any():  # all columns together
            total = gains.sum(axis=0)
            k = int(total.argmax())
            saved = float(total[k] / tokens.sum())
            return [(names[k], len(gains), saved)] if total[k] >= first and saved >= accept.per_token else []
        if not strong.any():
            continue
        known = np.where(strong >= max(1, strong.max() * accept.share), gains, -np.inf)
        own = np.where(most >= first, top, np.where(known.max(axis=1) >= second, known.argmax(axis=1), -1))
        count = np.bincount(own[own >= 0], minlength=len(names))
        saved = np.array([gains[own == k, k].sum() for k in range(len(names))])
        length = np.bincount(own[own >= 0], tokens[own >= 0], minlength=len(names))
        order = np.lexsort((-saved, -count))
        out = [order[0]]
        if len(order) > 1 and count[order[1]] >= accept.least and count[order[1]] >= accept.share * count[order[0]]:
            out.append(order[1])
        return [(names[k], int(count[k]), float(saved[k] / length[k])) for k in out if saved[k] >= accept.per_token * length[k]]
    return []


class Labelled(NamedTuple):
    """A labelled document."""

    wanted: set
    prose: list
    columns: list


def fit(names: list[str], documents: list[Labelled], background: Counter, total: float) -> Models:
    """Models by a few rounds of hard assignment.

    In the first round a document's sentences are shared among its subjects; later, a sentence counts
    for the subject it is of if that is one of its document's.
    """
    models = None
    for _ in range(ROUNDS):
        sums = {s: Counter() for s in names}
        for document in documents:
            _assign(sums, models, *document)
        models = Models(names, sums, background, total)
    return models


class Fold(NamedTuple):
    """How labelled documents left out were judged: right pairs of document and subject, pairs found, pairs labelled."""

    documents: int
    right: int
    found: int
    labelled: int


def train(names: list[str], documents: list[Labelled], background: Counter, total: float) -> tuple[Models, Acceptance, list[Fold]]:
    """Models of all documents, and thresholds calibrated by models that did not see what they are tried on."""
    folds = []
    for n in range(FOLDS):
        held = documents[n::FOLDS]
        if held and len(held) < len(documents):
            models = fit(names, [d for i, d in enumerate(documents) if i % FOLDS != n], background, total)
            folds.append([(d.wanted, Scored.of(models, d.prose), Scored.of(models, d.columns)) for d in held])

    def tried(accept: Acceptance) -> list[Fold]:
        out = []
        for fold in folds:
            got = [({s for s, *_ in judge(names, p, c, accept)}, w) for w, p, c in fold]
            out.append(Fold(len(got), sum(len(g & w) for g, w in got), sum(len(g) for g, _ in got), sum(len(w) for _, w in got)))
        return out

    def f1(report: list[Fold]) -> float:
        return 2 * sum(f.right for f in report) / max(1, sum(f.found + f.labelled for f in report))

    accept = Acceptance()
    report = tried(accept)
    for field, values in _TRIED.items() if folds else ():
        for value in values:
            trial = accept._replace(**{field: value})
            if trial != accept and f1(new := tried(trial)) > f1(report) + 1e-9:
                accept, report = trial, new
    return fit(names, documents, background, total), accept, report


def _assign(sums: dict[str, Counter], models: Models | None, wanted: set, prose: list, columns: list) -> None:
    if models is None:
        for sentence in [*prose, *columns]:
            for s in wanted:
                for g in grams(sentence):
                    sums[s][g] += 1 / len(wanted)
        return
    for part, least in ((prose, LEAST_GAIN / 2), (columns, 0.3)):
        gains = models.gains(part)
        for sentence, row in zip(part, gains):
            k = int(row.argmax())
            if row[k] >= least and models.names[k] in wanted:
                sums[models.names[k]].update(grams(sentence))


_FEATURES = "id bigint, prose array<array<string>>, columns array<array<string>>, words bigint"


def _features(rows: DataFrame) -> DataFrame:
    """``id``, ``prose``, ``columns``, ``words`` of rows with id and text: a text without its outputs and images."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = pa.list_(pa.list_(pa.string()))
        for batch in batches:
            found = [sentences(t) for t in batch.column("text").to_pylist()]
            sizes = [sum(map(len, p)) + sum(map(len, c)) for p, c in found]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([p for p, _ in found], listed), pa.array([c for _, c in found], listed), pa.array(sizes, pa.int64())], names=["id", "prose", "columns", "words"])

    return rows.mapInArrow(extract, _FEATURES)


def subject_models(documents: DataFrame, subjects: DataFrame, labels: DataFrame) -> tuple[Models, Acceptance, list[Fold]] | None:
    """Models, thresholds and how these did by fold; None without subjects or usable labels.

    Labels are matched to subjects without regard to case and outer blanks, others are dropped. The words
    of at most ``LABELLED`` labelled documents, the first by a hash of their id up to ``LABELLED_WORDS``
    words, are brought to the driver; the background counts their words and pairs over all documents.
    """
    names = {r[0].strip().lower(): r[0] for r in subjects.select("subject").filter("subject is not null").distinct().orderBy("subject").collect()}
    known = documents.sparkSession.createDataFrame([(k, v) for k, v in names.items()], "key string, name string")
    marks = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.lower(F.trim("subject")).alias("key")).join(F.broadcast(known), "key").groupBy("id").agg(F.collect_set("name").alias("wanted"))
    rows = documents.select(F.col("doc_id").cast("bigint").alias("id"), "text").filter("text is not null")
    some = marks.select("id", "wanted", F.xxhash64(F.lit(1), "id").alias("o")).orderBy("o", "id").limit(LABELLED)
    made = cut(_features(rows.join(F.broadcast(some.select("id")), "id", "left_semi")).join(F.broadcast(some), "id"))
    until = F.sum("words").over(Window.orderBy("o", "id", "words").rowsBetween(Window.unboundedPreceding, -1))  # of at most LABELLED documents
    texts = made.withColumn("before", F.coalesce(until, F.lit(0))).filter(F.col("before") < LABELLED_WORDS).collect()
    texts = sorted({r["id"]: r for r in sorted(texts, key=lambda r: r["words"])}.values(), key=lambda r: (r["o"], r["id"]))
    if not texts:
        return None
    labelled = [Labelled(set(r["wanted"]), [tuple(x) for x in r["prose"]], [tuple(x) for x in r["columns"]]) for r in texts]
    seen = Counter(g for _, prose, columns in labelled for sentence in [*prose, *columns] for g in grams(sentence))
    keys = list(seen)  # also what was seen once: the models hold it, and it may be frequent elsewhere
    shared = documents.sparkSession.sparkContext.broadcast({g: i for i, g in enumerate(keys)})

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, counts, total = shared.value.get, np.zeros(len(shared.value), np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                prose, columns = sentences(text)
                total += sum(map(len, prose)) + sum(map(len, columns))
                found = [i for part in (prose, columns) for sentence in part for g in grams(sentence) if (i := get(g)) is not None]
                counts += np.bincount(found, minlength=len(counts)) if len(found) > len(counts) // 50 else 0
                if len(found) <= len(counts) // 50:
                    np.add.at(counts, found, 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counts[at], total))], names=["gram", "n"])

    counted = spread(rows.select("text")).mapInArrow(tally, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    sums = dict(zip(counted.column("gram").to_pylist(), counted.column("n").to_pylist()))
    total = sums.pop(-1, 0)
    background = Counter({keys[i]: n for i, n in sums.items()})
    return train(sorted(names.values()), labelled, background, total)


def calibration(documents: DataFrame, subjects: DataFrame, labels: DataFrame) -> DataFrame:
    """``fold``, ``documents``, ``precision``, ``recall`` against the labels, and the thresholds taken; no row without usable labels."""
    made = subject_models(documents, subjects, labels)
    _, accept, report = made or (None, Acceptance(), [])
    rows = [(n, f.documents, f.right / f.found if f.found else None, f.right / f.labelled if f.labelled else None, *map(float, accept)) for n, f in enumerate(report)]
    return documents.sparkSession.createDataFrame(rows, "fold int, documents int, precision double, recall double, gain double, per_token double, least double, share double")


def areas(documents: DataFrame, subjects: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``subject``, ``n_sentences``, ``gain``: the one or two subjects of each document.

    ``gain`` is by how much the subject's cross-entropy over its sentences, per token, is below the background's.

    A null or empty text has none, nor has any document if no label can be used. A null id is kept, a
    repeated row gives its rows again. Only doc_id and text, subject, and doc_id and subject of the
    three tables are read.
    """
    schema = "doc_id bigint, subject string, n_sentences int, gain double"
    made = subject_models(documents, subjects, labels)
    if made is None:
        return documents.sparkSession.createDataFrame([], schema)
    shared = documents.sparkSession.sparkContext.broadcast(made)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, accept, _ = shared.value
        for batch in batches:
            out = []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                out += [(key, *x) for x in judge(models.names, *(Scored.of(models, x) for x in sentences(text)), accept)]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.float64()))], names=["doc_id", "subject", "n_sentences", "gain"])

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(F.length("text") > 0)
    return spread(rows).mapInArrow(assign, schema)
