"""Generated, minified, vendored and bulk-data source files.

Linear support-vector classifiers on hashed character n-grams and path components, one for each kind.
Labels come from giveaways: headers that name a generator or an upstream release, directories of
vendored code, names of minified scripts, texts that are almost all literals. The giveaways are masked
before the features are taken, so the classifiers learn the code itself and find files that lack them.

Giveaways are looked for in every file, and so is what the files hold in common: how much of a file
stands in vendored files, anywhere in the table, is one more feature. Only the fit is on a bounded sample,
drawn kind by kind from all rows; features are taken where the rows are read. Validation is split by
repository, and gives the border from which a score counts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.plans.runtime import cut, spread

GENERATED, MINIFIED, VENDORED, BULK, WRITTEN = "generated", "minified", "vendored", "bulk", "hand-written"
KINDS = (GENERATED, MINIFIED, VENDORED, BULK)
#: Files that the classifiers are fitted on, at most, of each kind and without a giveaway, the first by a hash of
#: their id; and features of them together.
SAMPLE_KIND, SAMPLE_OTHER = 800, 3200
SAMPLE_FEATURES = 24_000_000
BITS = 17
GRAM_SIZES = (4, 7)
EPOCHS = 10
#: Parts of the repositories for validation.
FOLDS = 3
#: Five-word shingles of a file, those of least hash, that are looked up among the shingles of vendored files.
SHINGLES = 16
#: Shares of these found there, from which a file is in the next class; 0.8 and more is a copy.
SHARES = (0.2, 0.5, 0.8)
#: Borders that are tried on the repositories left out.
BORDERS = tuple(round(-0.6 + 0.05 * i, 2) for i in range(17))
#: From this score on, by a fit on other repositories, a file without a giveaway is an example of the kind.
SURE = 0.1

#: Extensions of code; configuration and documentation are never cases.
CODE = {"py", "pyi", "js", "mjs", "cjs", "jsx", "ts", "tsx", "mts", "go", "java", "rs", "c", "h", "cc", "cpp", "cxx", "hpp", "hh", "hxx", "kt", "scala", "rb", "php", "swift", "cs", "m", "mm", "css", "scss", "lua", "pl", "r"}
#: Directories whose content is taken over from other projects, and those where that is common.
VENDOR_DIRS = {"node_modules", "vendor", "third_party", "third-party", "thirdparty", "bower_components", "site-packages", "_vendor"}
MIXED_DIRS = {"external", "deps", "contrib", "extern", "lib3p"}
_HEADER_GENERATED = re.compile(
    r"(?i)@generated|\bauto[- ]?generated\b|generated (?:by|from|code|file|using|with)|code generated|do not (?:edit|modify)|(?:never|don't) edit|not be edited|regenerate|machine.generated|this file (?:is|was) (?:produced|created|written) by|produced by (?:the )?\w+ (?:compiler|tool|generator)|created by \w+ (?:compiler|generator)|output of \w+"
)
_HEADER_VENDORED = re.compile(
    r"(?i)\bvendored\b|\bupstream(?:\s*:|\s+(?:source|version|revision|project|at|from))|third[- ]party (?:code|source|library|copy)|\btaken over\b|\b(?:imported|copied) (?:verbatim |unchanged )?from\b"
)
# A copyright or licence alone says nothing: the project's own files have them. With a release of a named project it does.
_RELEASE = re.compile(r"(?i)(?<![\w.@/\-])[a-z@][\w.@/\-]*+,? v?\d+\.\d+(?:\.\d+)+")
_RIGHTS = re.compile(r"(?i)licen[cs]ed? |copyright|released under|\(c\)|https?://")
_COMMENT = re.compile(r"\s*(?:/\*.*?\*/|(?://|#(?!include|define|if|pragma|!\[|\[)|--)[^\n]*\n?|\"\"\".*?\"\"\"|'''.*?''')", re.S)
_MIN_NAME = re.compile(r"(?i)[.\-_](?:min|bundle|packed|prod)\.(?:js|mjs|cjs|css)$")
_GEN_NAME = re.compile(r"(?i)(?:\.pb\.(?:go|cc|h)|_pb2(?:_grpc)?\.py|_pb\.(?:js|ts|d\.ts)|_grpc\w*\.\w+|OuterClass\.java|\.g(?:en(?:erated)?)?\.(?:ts|js|go|dart|cs|java|rs|py)|\.tab\.[ch]|\.designer\.cs|_generated\.\w+)$")
_LITERAL = re.compile(r"0[xX][0-9a-fA-F]+|[-+]?\b\d[\d_.]*(?:[eE][-+]?\d+)?|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|(?<=\n)[A-Za-z0-9+/=]{40,}(?=\n)")


_SEPARATORS = dict.fromkeys(map(ord, " \t\r\n\f\v,;()[]{}"))


def extension(name: str | None) -> str:
    """The extension of a path, lower case; empty for names without one."""
    last = (name or "").rsplit("/", 1)[-1]
    return last.rsplit(".", 1)[-1].lower() if "." in last[1:] else ""


def leading_comments(text: str) -> int:
    """End of the comments and blanks with which a text begins."""
    at = 0
    while m := _COMMENT.match(text, at):
        if m.end() == at:
            break
        at = m.end()
    return at


def literal_share(text: str) -> float:
    """Share of literals among the characters that are no blanks or separators."""
    body = len(text.translate(_SEPARATORS))
    inside = len("".join(_LITERAL.findall("\n" + text + "\n")).translate(_SEPARATORS))
    return inside / body if body else 0.0


def giveaway(name: str | None, text: str) -> str | None:
    """The kind that a header, a path or sheer form gives away, or None."""
    parts = (name or "").split("/")
    if any(p in VENDOR_DIRS for p in parts[:-1]):
        return VENDORED
    head = text[: leading_comments(text)]
    if _HEADER_GENERATED.search(head) or _GEN_NAME.search(parts[-1]):
        return GENERATED
    if _HEADER_VENDORED.search(head) or _RELEASE.search(head) and _RIGHTS.search(head):
        return VENDORED
    lines = [line for line in text.split("\n") if line.strip()]
    if extension(name) in ("js", "mjs", "cjs", "css", "ts") and (_MIN_NAME.search(parts[-1]) or (len(text) > 400 and len(text) / max(1, len(lines)) > 250)) and text.count(" ") < 0.12 * len(text):
        return MINIFIED
    if (len(lines) >= 15 or len(text) >= 1500) and literal_share(text) > 0.85:
        return BULK
    return None


def masked_text(text: str) -> str:
    """The text without its leading comments."""
    return text[leading_comments(text) :]


def masked_path(name: str | None) -> list[str]:
    """Components of the path, without those that give a kind away."""
    parts = [p for p in (name or "").lower().split("/") if p not in VENDOR_DIRS and p not in MIXED_DIRS]
    if parts:
        parts[-1] = _GEN_NAME.sub("", _MIN_NAME.sub("", parts[-1]))
    stem = re.split(r"[^a-z0-9]+", parts[-1])[0:1] if parts else []
    return [*parts[:-1], *stem, "." + extension(name)]


_POWERS = {n: np.array([pow(0x01000193, i, 1 << 32) for i in range(n)], np.uint32) for n in GRAM_SIZES}


def features(name: str | None, text: str) -> np.ndarray:
    """Sorted distinct hashes of the character n-grams of the masked text and of the masked path."""
    raw = np.frombuffer(re.sub(r"[ \t\r\n]+", " ", masked_text(text)).encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    out = []
    for n in GRAM_SIZES:
        if len(raw) >= n:
            h = np.zeros(len(raw) - n + 1, np.uint32)
            for j in range(n):
                h += raw[j : j + len(h)] * _POWERS[n][j]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            out.append(h >> np.uint32(32 - BITS))
    out.append(np.array([zlib.crc32(f"{n}:{p}".encode()) & ((1 << BITS) - 1) for n, p in enumerate(masked_path(name))], np.uint32))
    return _distinct(np.concatenate(out))


def _distinct(values: np.ndarray) -> np.ndarray:
    values.sort()
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


class Classifiers(NamedTuple):
    """For each kind: weights, bias, weights of the shares found in vendored files, and the border."""

    weights: np.ndarray
    bias: np.ndarray
    shares: np.ndarray
    borders: np.ndarray

    def scores(self, found: np.ndarray) -> np.ndarray:
        """Signed distances of a file for each kind, but for its share."""
        return self.weights[:, found].sum(axis=1) / max(1.0, len(found)) ** 0.5 + self.bias


def fit_svm(rows: list[np.ndarray], share: np.ndarray, wanted: np.ndarray, cost: np.ndarray, seed: int = 3) -> tuple[np.ndarray, float, np.ndarray]:
    """Dual coordinate descent for a linear SVM with hinge loss; rows are unit vectors with equal entries, the bias is a feature of 1 and the class of the share one of 2."""
    rng = np.random.default_rng(seed)
    w, b, e = np.zeros(1 << BITS, np.float32), 0.0, np.zeros(len(SHARES) + 1)
    alpha = np.zeros(len(rows))
    sign = np.where(wanted, 1.0, -1.0)
    scale = np.array([1 / max(1, len(r)) ** 0.5 for r in rows])
    active = np.arange(len(rows))
    for _ in range(EPOCHS):
        rng.shuffle(active)
        moved, kept = 0.0, []
        for i in active:
            r, s = rows[i], scale[i]
            gradient = sign[i] * (w[r].sum() * s + b + e[share[i]]) - 1
            if alpha[i] > 0 or gradient < 0.3:  # others are far on their side and rest
                kept.append(i)
            new = min(max(alpha[i] - gradient / 6, 0.0), cost[i])  # the squared norm is 1, and 1 and 4 for bias and share
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[r] += step * s
                b += step
                e[share[i]] += 4 * step
                moved = max(moved, abs(step))
                alpha[i] = new
        active = np.array(kept, np.int64)
        if moved < 1e-2:
            if len(kept) == len(rows):
                break
            active = np.arange(len(rows))
    return w, b, e


class Example(NamedTuple):
    """A file of the sample: its repository, kind by giveaway, class of its share in vendored files, features."""

    repo: str | None
    kind: str | None
    share: int
    found: np.ndarray


class Report(NamedTuple):
    """A kind on repositories left out: examples, those of them found at the border, and files without a giveaway beyond it."""

    kind: str
    border: float
    examples: int
    found: int
    others: int
    mistaken: int


def train(sample: list[Example]) -> tuple[Classifiers, list[Report]]:
    """Classifiers and what the validation found.

    A file without a giveaway that is a copy of a vendored one is no example of hand-written code but of
    vendored code. Each part of the repositories is scored by a fit on the others. Files without a giveaway that such
    a fit takes for a kind join it in the last fit, which uses all repositories, and are left out of it
    where the score is near the border. The border is the score with the fewest mistakes on the parts left out:
    examples below it, and hand-written files above it, whose number is estimated by the mirror image of their
    scores about the median, as files without a giveaway may be of the kind.
    """
    rows, share = [x.found for x in sample], np.array([x.share for x in sample], np.int64)
    kinds = [VENDORED if x.kind is None and x.share == len(SHARES) else x.kind for x in sample]
    fold = np.array([zlib.crc32((x.repo or "").encode()) % FOLDS for x in sample])
    fits, borders, report = [], [], []
    for kind in KINDS:
        wanted = np.array([k == kind for k in kinds], bool)
        use = np.array([k in (None, kind) for k in kinds], bool)
        score = np.full(len(rows), -1.0)
        for n in np.unique(fold):
            inside = fold == n
            if not inside.all():
                w, b, e = _fit(rows, share, wanted, np.flatnonzero(use & ~inside))
                score[inside] = [w[rows[i]].sum() / max(1, len(rows[i])) ** 0.5 + b + e[share[i]] for i in np.flatnonzero(inside)]
        other = score[use & ~wanted]
        middle = float(np.median(other)) if len(other) else -1.0
        mistakes = [int((wanted & (score <= t)).sum()) + int((other < 2 * middle - t).sum()) for t in BORDERS]
        least = [t for t, n in zip(BORDERS, mistakes) if n == min(mistakes)]
        border = least[len(least) // 2] if wanted.any() else 0.0
        borders.append(border)
        report.append(Report(kind, border, int(wanted.sum()), int((wanted & (score > border)).sum()), len(other), int((other < 2 * middle - border).sum())))
        sure = wanted | (use & (score > SURE))
        fits.append(_fit(rows, share, sure, np.flatnonzero(use & (sure | (score < border - 0.1)))))
    w, b, e = zip(*fits)
    return Classifiers(np.stack(w), np.array(b), np.stack(e), np.array(borders)), report


def _fit(rows: list[np.ndarray], share: np.ndarray, wanted: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    here = wanted[use]
    if not here.any() or here.all():
        return np.zeros(1 << BITS, np.float32), 1.0 if here.any() else -1.0, np.zeros(len(SHARES) + 1)
    balance = min(8.0, (len(here) - here.sum()) / here.sum()) ** 0.5
    return fit_svm([rows[i] for i in use], share[use], here, np.where(here, 10.0 * balance, 10.0))


def _key():
    """Stands for a file's id and name in joins."""
    return F.xxhash64("id", "name")


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of a text without its leading comments."""
    words = np.array([*map(_HASHES.__getitem__, _WORD.findall(text, leading_comments(text)))], np.uint64)
    n = len(words) - 4
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(5):
        h = (h ^ words[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique(h.view(np.int64))


_WORD = re.compile(r"\w+|[^\w\s]")


class _Hashes(dict):
    """Hashes of words, kept up to a number of them."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        self[word] = made = zlib.crc32(word.encode("utf-8", "replace"))
        return made


_HASHES = _Hashes()


def _facts(rows: DataFrame) -> DataFrame:
    """``id``, ``name``, ``repo``, ``k``, ``kind`` by giveaway, ``hashes`` of each file: of a vendored one all its shingles, of another those of least hash; k stands for id and name."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, hashes = [], []
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist()):
                kind = giveaway(name, text)
                kinds.append(kind)
                found = shingles(text) if kind in (None, VENDORED) else np.empty(0, np.int64)
                hashes.append(found if kind == VENDORED else found[:SHINGLES])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "name", "repo", "k")), pa.array(kinds, pa.string()), pa.array(hashes, pa.list_(pa.int64()))], names=["id", "name", "repo", "k", "kind", "hashes"])

    kind = rows.schema["id"].dataType.simpleString()
    return spread(rows.withColumn("k", _key())).mapInArrow(look, f"id {kind}, name string, repo string, k bigint, kind string, hashes array<bigint>")


def _shares(facts: DataFrame) -> DataFrame:
    """``k``, ``share``: class of the share of a file's shingles that stand in vendored files other than itself; files of class 0 have no row.

    A shingle that a third of all files hold meets one row of the known ones; adaptive execution splits its side.
    """
    own = F.coalesce(F.col("kind") == VENDORED, F.lit(False))
    known = facts.filter(own).select("k", F.explode("hashes").alias("h")).groupBy("h").agg((F.min("k") != F.max("k")).alias("several"))
    asked = facts.filter(own | F.col("kind").isNull()).select("k", own.alias("own"), F.slice("hashes", 1, SHINGLES).alias("hashes"))
    asked = asked.select("k", "own", F.size("hashes").alias("n"), F.explode("hashes").alias("h"))
    hits = asked.join(known, "h").filter(~F.col("own") | F.col("several")).groupBy("k").agg(F.max("n").alias("n"), F.size(F.collect_set("h")).alias("hits"))  # at most SHINGLES each
    share = sum(((F.col("hits") >= s * F.col("n")).cast("int") for s in SHARES), F.lit(0))
    return hits.select("k", share.alias("share")).filter("share > 0")


def _source(df: DataFrame, id_col: str, repo_col: str, name_col: str, text_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).alias("id"), F.col(repo_col).alias("repo"), F.col(name_col).alias("name"), F.col(text_col).alias("text"))
    code = F.lower(F.regexp_extract("name", r"[^/]\.([A-Za-z]+)$", 1)).isin(*sorted(CODE))
    return rows.filter(code & (F.length("text") > 0))


def _fitted(rows: DataFrame) -> tuple[DataFrame, tuple[Classifiers, list[Report]] | None]:
    """Shares of the rows, and the classifiers fitted on a sample of them."""
    facts = cut(_facts(rows))
    shares = cut(_shares(facts))
    order = F.xxhash64(F.lit(5), "k").alias("o")
    some = None
    for kind in (*KINDS, None):
        size = SAMPLE_KIND if kind else SAMPLE_OTHER
        picked = facts.filter(F.col("kind").eqNullSafe(F.lit(kind))).select("k", "repo", "kind", order)
        part = picked.orderBy("o", "k", "repo").limit(2 * size).distinct().orderBy("o", "k", "repo").limit(size)  # rows may be delivered twice
        some = part if some is None else some.union(part)
    some = cut(F.broadcast(some).join(shares, "k", "left").select("k", "repo", "kind", "o", F.coalesce("share", F.lit(0)).alias("share")))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(n, t).astype(np.int32) for n, t in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(found, pa.list_(pa.int32())), pa.array(map(len, found), pa.int64())], names=["k", "found", "size"])

    chosen = rows.select(_key().alias("k"), "name", "text").join(F.broadcast(some.select("k")), "k", "left_semi")
    taken = cut(chosen.mapInArrow(take, "k bigint, found array<int>, size bigint").join(F.broadcast(some), "k"))
    sizes = taken.groupBy("o").agg(F.sum("size").alias("size"))  # of a bounded sample
    before = F.sum("size").over(Window.orderBy("o").rowsBetween(Window.unboundedPreceding, -1))
    last = sizes.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < SAMPLE_FEATURES).agg(F.max("o")).first()[0]
    table = taken.filter(F.col("o") <= last).select("o", "size", "repo", "kind", "share", "found").toArrow() if last is not None else taken.limit(0).toArrow()
    table = table.sort_by([("o", "ascending"), ("size", "ascending"), ("repo", "ascending")])
    sample = [Example(r, k, s, np.asarray(f.values)) for r, k, s, f in zip(*(table.column(c).to_pylist() for c in ("repo", "kind", "share")), table.column("found"))]
    return shares, train(sample) if sample else None


def classify(df: DataFrame, id_col: str = "file_id", repo_col: str = "repo", name_col: str = "name", text_col: str = "text") -> DataFrame:
    """``id``, ``kind``, ``score``: files that are generated, minified, vendored or bulk data; a score is the distance from the kind's border.

    Files without an extension of code, and null or empty texts, are no cases; a null name has no
    extension. A repeated row gives its row again. The classifiers are fitted on a bounded sample (``SAMPLE_KIND``,
    ``SAMPLE_OTHER``, ``SAMPLE_FEATURES``); without any giveaway among the rows there are no cases. Only
    the four named columns are read.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    rows = _source(df, id_col, repo_col, name_col, text_col)
    shares, made = _fitted(rows)
    if made is None:
        return spark.createDataFrame([], f"id {kind}, kind string, score double")
    shared = spark.sparkContext.broadcast(made[0])
    most = made[0].shares.max(axis=1)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            names, texts = (batch.column(c).to_pylist() for c in ("name", "text"))
            scores = np.array([fitted.scores(features(n, t)) for n, t in zip(names, texts)]).reshape(-1, len(KINDS))
            open_ = np.flatnonzero((scores + most > fitted.borders).any(axis=1))  # no share can lift the others over a border
            kept = batch.select(["id", "k"]).take(pa.array(open_))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(list(scores[open_]), pa.list_(pa.float64()))], names=["id", "k", "scores"])

    scored = spread(rows.select("id", "name", "text", _key().alias("k"))).mapInArrow(judge, f"id {kind}, k bigint, scores array<double>").join(shares, "k", "left")
    lift = F.array(*(F.element_at(F.array(*map(F.lit, map(float, made[0].shares[k] - made[0].borders[k]))), F.coalesce("share", F.lit(0)) + 1) for k in range(len(KINDS))))
    scored = scored.withColumn("scores", F.zip_with("scores", lift, lambda a, b: a + b)).withColumn("score", F.array_max("scores")).filter("score > 0")
    return scored.select("id", F.element_at(F.array(*map(F.lit, KINDS)), F.array_position("scores", F.col("score")).cast("int")).alias("kind"), "score")


def validation(df: DataFrame, id_col: str = "file_id", repo_col: str = "repo", name_col: str = "name", text_col: str = "text") -> DataFrame:
    """``kind``, ``border``, ``examples``, ``found``, ``others``, ``mistaken``: how the classifiers did on repositories left out; no row without a sample."""
    _, made = _fitted(_source(df, id_col, repo_col, name_col, text_col))
    return df.sparkSession.createDataFrame(made[1] if made else [], "kind string, border double, examples int, found int, others int, mistaken int")
