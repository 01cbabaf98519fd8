"""Named queries over the driver's tables; each takes a session and a folder of tables.

Files are identified by ``repo/name``; of a record that was delivered more than once, the last delivery counts.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.functions import columns as C
from tesserae.operators import answer, chunking, embed, index, retrieve, rules
from tesserae.plans.runtime import broadcast_within, cut, table, temporary
from tesserae.sources import changes as change_log
from tesserae.sources.snapshot import SnapshotStore
from tesserae.streaming import feed

#: Patterns of the example ignore file.
PATTERNS = ["*.md", "deploy/", "ops/", "tests", "*_test.py", "lib/util/[a-f]*"]
TOP_K = 8
DIM = 64
MAX_CHARS = 6000


def _latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """One row for each key: the last version, ties by the row itself.

    Which keys were delivered more than once is found on key and version alone. Rows of the others stay
    where they are: no text or vector is exchanged for them.
    """
    rest = [c for c in df.columns if c not in (key, version)]
    repeated = cut(df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(version).alias("newest")).filter("n > 1").select(F.col(key).alias("again"), "newest"))
    once = df.join(repeated, F.col(key).eqNullSafe(F.col("again")), "left_anti")
    newest = df.join(repeated, F.col(key).eqNullSafe(F.col("again")) & F.col(version).eqNullSafe(F.col("newest"))).drop("again", "newest")
    last = newest.groupBy(key).agg(F.max_by(F.struct(version, *rest), F.xxhash64(*rest)).alias("r")).select(key, "r.*")
    return once.select(key, version, *rest).unionByName(last)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file_id``, ``repo``, ``name``, ``rel_path``, ``text``: each file once."""
    rows = table(spark, sf_dir, "files").select("file_id", "repo", "name", "ingested_at", "text")
    return _latest(rows, "file_id", "ingested_at").withColumn("rel_path", F.concat_ws("/", "repo", "name"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file_id``, ``rel_path``, without reading any text."""
    return table(spark, sf_dir, "files").select("file_id", F.concat_ws("/", "repo", "name").alias("rel_path")).distinct()


def chunks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Chunk columns by their flat names, each chunk once; only the named ones are read."""
    flat = {
        "file": F.concat_ws("/", "repo", "metadata.file"), "start_line": F.col("metadata.start_line"), "end_line": F.col("metadata.end_line"),
        "symbol": F.col("metadata.symbol"), "language": F.col("metadata.language"),
    }
    rows = table(spark, sf_dir, "chunks").select("chunk_id", "indexed_at", *(flat.get(c, F.col(c)).alias(c) for c in columns))
    return _latest(rows, "chunk_id", "indexed_at").drop("indexed_at")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``question_id``, ``question``: each question once."""
    return table(spark, sf_dir, "questions").select("question_id", "question").filter("question is not null").distinct()


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change records, each once."""
    return _latest(table(spark, sf_dir, "changes"), "change_id", "received_at")


# Files and rules


def file_catalog(spark, sf_dir):
    f = files(spark, sf_dir)
    return f.select("file_id", "rel_path", C.basename(F.col("rel_path")).alias("base"), C.extension(F.col("rel_path")).alias("extension"), F.length("text").cast("bigint").alias("n_chars"), C.line_count(C.universal_newlines(F.col("text"))).cast("bigint").alias("n_lines"))


def content_hash(spark, sf_dir):
    return files(spark, sf_dir).select("file_id", C.content_hash(F.col("text")).alias("sha256"))


def skip_reason(spark, sf_dir):
    f = files(spark, sf_dir)
    return f.select("file_id", rules.skip_reason(F.col("name"), F.encode("text", "UTF-8"), PATTERNS).alias("reason"))


def secret_filter(spark, sf_dir):
    names = file_names(spark, sf_dir).select("rel_path").union(table(spark, sf_dir, "changes").select(F.concat_ws("/", "repo", "path"))).distinct()
    return names.select("rel_path", rules.is_secret(F.col("rel_path")).alias("secret"))


def ignore_patterns(spark, sf_dir):
    names = table(spark, sf_dir, "files").select("name").distinct()
    marked = [F.when(rules.matches_pattern(F.col("name"), p), p) for p in PATTERNS]
    return names.select("name", F.explode(F.array_compact(F.array(*marked))).alias("pattern"))


def binary_ratio(spark, sf_dir):
    ratio = C.text_byte_ratio(F.encode("text", "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(ratio, 6).alias("ratio"), (ratio < 0.75).alias("is_binary"))


def duplicate_content(spark, sf_dir):
    hashed = files(spark, sf_dir).select("repo", C.content_hash(F.col("text")).alias("sha256"))
    return hashed.groupBy("sha256").agg(F.count(F.lit(1)).alias("n_files"), F.countDistinct("repo").alias("n_repos")).filter("n_files > 1")


# Differences and changes


def _deliveries(spark, sf_dir):
    """Hash of each path by its last delivery up to the middle of the time of all deliveries, and by its last of all."""
    rows = table(spark, sf_dir, "files").filter("file_hash is not null").select(F.concat_ws("/", "repo", "name").alias("file"), "file_hash", F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("at"))
    middle = rows.agg(F.floor((F.min("at") + F.max("at")) / 2).alias("middle"))
    last = lambda df: df.groupBy("file").agg(F.max_by("file_hash", F.struct("at", "file_hash")).alias("file_hash"))
    return last(rows.crossJoin(F.broadcast(middle)).filter("at <= middle")), last(rows)  # one row


def stale_files(spark, sf_dir):
    known = table(spark, sf_dir, "changes").select(F.concat_ws("/", "repo", "path").alias("file")).union(table(spark, sf_dir, "chunks").select(F.concat_ws("/", "repo", "metadata.file"))).distinct()
    return index.stale(known, file_names(spark, sf_dir).select(F.col("rel_path").alias("file")))


def unchanged_files(spark, sf_dir):
    known, now = _deliveries(spark, sf_dir)
    return index.unchanged(now, known, ["file", "file_hash"]).select("file")


def to_process(spark, sf_dir):
    """Files that an index of the first half of the time would have to take in, those without a hash among them."""
    known, now = _deliveries(spark, sf_dir)
    current = file_names(spark, sf_dir).select(F.col("rel_path").alias("file")).join(now, "file", "left").select("file", F.coalesce("file_hash", F.lit("")).alias("file_hash"))
    return index.to_process(current, known, ["file", "file_hash"]).select("file")


def parse_changes(spark, sf_dir):
    c = changes(spark, sf_dir)
    line = F.concat_ws("\t", F.when(F.col("status") == "R", "R100").otherwise(F.col("status")), "path", F.when(F.col("status") == "R", F.col("new_path")))
    return change_log.parse_lines(c.select("change_id", line.alias("line")), order="change_id").withColumnRenamed("ord", "change_id")


def parse_change_logs(spark, sf_dir):
    """The changes of each repository as one log of NUL-delimited records, parsed."""
    status = F.when(F.col("status") == "R", "R100").otherwise(F.col("status"))
    record = F.concat(F.concat_ws("\0", status, "path", F.when(F.col("status") == "R", F.col("new_path"))), F.lit("\0"))
    logs = changes(spark, sf_dir).groupBy("repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("change_id", record.alias("r")))), lambda x: x["r"]), "").alias("raw"))
    return change_log.parse_logs(logs, "repo")


def plan_reindex(spark, sf_dir):
    c = changes(spark, sf_dir).select("status", F.concat_ws("/", "repo", "path").alias("path"), F.when(F.col("new_path").isNotNull(), F.concat_ws("/", "repo", "new_path")).alias("new_path"))
    present = table(spark, sf_dir, "files").select(F.concat_ws("/", "repo", "name").alias("path"), "name").distinct()
    may = present.filter(rules.path_skip_reason(F.col("name"), PATTERNS).isNull()).select("path")
    return index.plan_changes(c, present.select("path"), may)


def apply_changes(spark, sf_dir):
    acts = feed.latest_action(changes(spark, sf_dir))
    have = table(spark, sf_dir, "files").select("repo", F.col("name").alias("path")).distinct().withColumn("origin", F.lit("indexed"))
    fresh = acts.filter("action = 'upsert'").select("repo", "path", F.lit("changed").alias("origin"))
    key = F.concat_ws("/", "repo", "path").alias("file")
    gone = acts.filter("action = 'delete'").select(key)
    return index.apply_changes(have.select(key, "origin"), fresh.select(key, "origin"), gone).select("file", "origin")


def snapshot_files(spark, sf_dir):
    hashed = table(spark, sf_dir, "files").filter("file_hash is not null").select(F.concat_ws("/", "repo", "name").alias("file"))
    return hashed.union(table(spark, sf_dir, "chunks").select(F.concat_ws("/", "repo", "metadata.file"))).distinct()


def stream_reindex(spark, sf_dir):
    """The feed as a stream, applied batch by batch to a table of the last action of each path.

    A batch is merged with the table that the batches before it left: late records change nothing that
    came after them.
    """
    state = feed.ActionTable(spark, temporary(spark, "actions"))
    feed.run_feed(_feed(spark, sf_dir), state.apply, "changes", temporary(spark, "offsets"))
    return state.rows().select("repo", "path", "action")


def _feed(spark, sf_dir) -> DataFrame:
    source = f"{sf_dir}/changes.parquet"
    return feed.read_feed(spark, source if os.path.isdir(source) else f"{sf_dir}/changes*.parquet")


def _tree(spark, sf_dir) -> DataFrame:
    """The files as a tree that an index is built of, with the time of their delivery."""
    at = F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("at")
    return cut(files(spark, sf_dir).select("rel_path", at, F.encode("text", "UTF-8").alias("content"), F.lit(None).cast("string").alias("error")))


def feed_index(spark, sf_dir):
    """An index that the change feed alone builds, batch by batch: its files and their hashes."""
    tree = _tree(spark, sf_dir)
    store = SnapshotStore(spark, temporary(spark, "store").removeprefix("file:"))
    state = feed.ActionTable(spark, temporary(spark, "actions"))
    indexed = feed.IndexedFeed(store, state, lambda paths: tree.join(paths, "rel_path", "left_semi"), PATTERNS, embed.EmbeddingConfig(dim=8))
    feed.run_feed(_feed(spark, sf_dir), indexed.apply, "index", temporary(spark, "offsets"))
    return store.file_hashes()


# Chunks


def whole_file_chunks(spark, sf_dir):
    f = files(spark, sf_dir).filter(~C.is_blank(F.col("text")))
    return f.select("file_id", F.lit(1).alias("start_line"), C.line_count(C.universal_newlines(F.col("text"))).alias("end_line"), C.extension(F.col("name")).alias("language"))


def chunk_coverage(spark, sf_dir):
    """Chunks by repository, and how many are exactly the lines they name."""
    lines = files(spark, sf_dir).select("file_id", F.split(C.universal_newlines(F.col("text")), "\n").alias("lines"))
    c = chunks(spark, sf_dir, "file_id", "repo", "start_line", "end_line", "text").join(lines, "file_id")
    body = F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return c.groupBy("repo").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(body == F.col("text")).alias("n_exact"))


def closing_chunks(spark, sf_dir):
    """Chunks of closing brackets and signs alone."""
    return chunks(spark, sf_dir, "text").filter(C.is_closing(F.col("text"))).select("chunk_id", F.length("text").alias("n_chars"))


def line_chunks(spark, sf_dir):
    return chunking.chunk_files(files(spark, sf_dir), mode="lines").select("file", "pos", "start_line", "end_line")


def ast_chunks(spark, sf_dir):
    return chunking.chunk_files(files(spark, sf_dir)).select("file", "pos", "start_line", "end_line", "symbol", "language", "text")


def _lines(chunks: DataFrame) -> DataFrame:
    """``file``, ``n_lines``, ``line_sum``, ``sha256``: the lines of each file's chunks that are not blank, as often as they stand in chunks."""
    rows = chunks.select("file", "start_line", F.posexplode(F.split("text", "\n")).alias("at", "line")).filter(~C.is_blank(F.col("line")))
    numbered = rows.select("file", (F.col("start_line") + F.col("at")).cast("bigint").alias("no"), "line")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "\n")
    return numbered.groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("no").alias("line_sum"), F.sha2(body, 256).alias("sha256"))


def ast_chunk_lines(spark, sf_dir):
    """Structure chunks by file: every line that is not blank in one of them, once, and as it stands in the file."""
    return _lines(chunking.chunk_files(files(spark, sf_dir)))


def line_chunk_lines(spark, sf_dir):
    """Chunks by lines, by file, as :func:`ast_chunk_lines`."""
    return _lines(chunking.chunk_files(files(spark, sf_dir), mode="lines"))


def snapshot_update(spark, sf_dir):
    """An index of the files up to the middle of the time, brought up to all of them in a second version, then changed by the feed's deletions: what it holds of each file."""
    store = SnapshotStore(spark, temporary(spark, "store").removeprefix("file:"))
    tree = _tree(spark, sf_dir)
    middle = tree.agg(F.floor((F.min("at") + F.max("at")) / 2)).first()[0]
    config = embed.EmbeddingConfig(dim=8)
    index.index_tree(store, tree.filter(F.col("at") <= middle), PATTERNS, config, "one")
    index.index_tree(store, tree, PATTERNS, config, "two")
    gone = changes(spark, sf_dir).filter("status = 'D'").select(F.lit("D").alias("status"), F.concat_ws("/", "repo", "path").alias("path"), F.lit(None).cast("string").alias("new_path"))
    index.reindex(store, gone, lambda paths: tree.join(paths, "rel_path", "left_semi"), PATTERNS, config, "three", "two")
    held = _lines(store.chunks()).select("file", "n_lines")
    return store.file_hashes().join(held, "file", "left").select("file", "file_hash", F.coalesce("n_lines", F.lit(0)).cast("bigint").alias("n_lines"))


def file_batches(spark, sf_dir):
    return index.file_batches(file_names(spark, sf_dir), "rel_path").select("rel_path", "batch")


def index_report(spark, sf_dir):
    first, last = _deliveries(spark, sf_dir)
    known = first.withColumnRenamed("file_hash", "old")
    joined = file_names(spark, sf_dir).select(F.col("rel_path").alias("file")).join(last, "file", "left").join(known, "file", "left")
    same = F.coalesce(F.col("file_hash") == F.col("old"), F.lit(False))
    return joined.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(same).alias("unchanged"), F.count_if(~same).alias("to_index"))


# Embeddings


def tokens(spark, sf_dir):
    words = table(spark, sf_dir, "documents").filter("text is not null").select(F.explode(C.tokens(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def hashed_embedding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return embed.slot_sums(docs, "doc_id", "text", DIM).select("doc_id", F.col("slot").cast("int").alias("slot"), F.round("value", 6).alias("value"))


def embedding_norm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    sums = embed.slot_sums(docs, "doc_id", "text", DIM)
    return sums.groupBy("doc_id").agg(F.round(F.sqrt(F.sum(F.col("value") * F.col("value"))), 6).alias("norm"))


def cosine_topk(spark, sf_dir):
    """The eight nearest of every vector whose id is divisible by 20, among all."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    items = e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    return retrieve.nearest(asked, items, TOP_K, digits=6)


def _asked(spark, sf_dir) -> DataFrame:
    q = questions(spark, sf_dir)
    return q.join(embed.hashed_vectors(q, "question_id", "question", DIM), "question_id")


def _alike(spark, sf_dir) -> DataFrame:
    """``question_id``, ``first_id``: every question, with the smallest id of those in the same words."""
    said = questions(spark, sf_dir).groupBy("question_id").agg(F.array_sort(F.collect_set("question")).alias("said"))
    return cut(said.select("question_id", F.min("question_id").over(Window.partitionBy("said")).alias("first_id")))


def _firsts(spark, sf_dir, alike: DataFrame) -> DataFrame:
    """``question_id``, ``question``: one question for those in the same words."""
    return questions(spark, sf_dir).join(alike.filter("question_id = first_id").select("question_id"), "question_id", "left_semi")


def _for_all(found: DataFrame, alike: DataFrame) -> DataFrame:
    """What was found for the first of the questions in the same words, for each of them."""
    return alike.join(found.withColumnRenamed("question_id", "first_id"), "first_id").drop("first_id")


def _knn(spark, sf_dir, firsts: DataFrame) -> DataFrame:
    asked = embed.hashed_vectors(firsts, "question_id", "question", DIM)
    return retrieve.nearest(asked, _vectors(spark, sf_dir), TOP_K, "question_id", "chunk_id", digits=6)


def _vectors(spark, sf_dir) -> DataFrame:
    return chunks(spark, sf_dir, "vector").filter(F.size("vector") == DIM)


def batch_knn(spark, sf_dir):
    """The eight nearest chunks of every question, all questions in one plan; those in the same words are searched for once."""
    alike = _alike(spark, sf_dir)
    return _for_all(_knn(spark, sf_dir, _firsts(spark, sf_dir, alike)), alike)


# Retrieval


def query_terms(spark, sf_dir):
    return retrieve.query_terms(questions(spark, sf_dir))


def _exact(spark, sf_dir) -> DataFrame:
    return retrieve.exact_matches(query_terms(spark, sf_dir), chunks(spark, sf_dir, "file", "symbol", "text"))


def exact_symbol(spark, sf_dir):
    return _exact(spark, sf_dir).filter("match = 'symbol'").select("question_id", "chunk_id")


def exact_definition(spark, sf_dir):
    return _exact(spark, sf_dir).filter("match = 'definition'").select("question_id", "chunk_id")


def exact_filename(spark, sf_dir):
    """Chunks by the file names in questions, and for each question by the path of the file with its number and that file's name alone."""
    asked = questions(spark, sf_dir).select("question_id")
    paths = table(spark, sf_dir, "files").select(F.col("file_id").alias("question_id"), "name").distinct().join(asked, "question_id", "left_semi")
    term = F.explode(F.array("name", C.basename(F.col("name")))).alias("term")
    terms = query_terms(spark, sf_dir).filter("kind = 'filename'").select("question_id", "kind", "term").union(paths.select("question_id", F.lit("filename"), term)).distinct()
    return retrieve.exact_matches(terms, chunks(spark, sf_dir, "file", "symbol", "text")).select("question_id", "chunk_id")


def _exact_scored(spark, sf_dir) -> DataFrame:
    facts = chunks(spark, sf_dir, "file", "start_line", "vector")
    scored = _exact(spark, sf_dir).join(facts, "chunk_id").join(_asked(spark, sf_dir).select("question_id", F.col("vector").alias("qv")), "question_id")
    score = F.when(F.size("vector") == DIM, C.cosine(F.col("qv"), F.col("vector"))).otherwise(F.lit(0.0))
    return scored.select("question_id", "chunk_id", "match", F.round(score, 6).alias("score"), "file", "start_line")


def exact_ranked(spark, sf_dir):
    """Exact hits of each question in order: kind of match, score, file, line; unlimited."""
    rank = F.when(F.col("match") == "symbol", 0).when(F.col("match") == "definition", 1).otherwise(2)
    window = Window.partitionBy("question_id").orderBy(rank, F.desc("score"), "file", F.coalesce("start_line", F.lit(0)), "chunk_id")
    return _exact_scored(spark, sf_dir).withColumn("rank", F.row_number().over(window)).select("question_id", "chunk_id", "match", "rank")


def _merged(spark, sf_dir, firsts: DataFrame) -> DataFrame:
    asked = embed.hashed_vectors(firsts, "question_id", "question", DIM)
    exact = retrieve.best_exact(retrieve.query_terms(firsts), asked, chunks(spark, sf_dir, "file", "start_line", "symbol", "text", "vector"), TOP_K)
    return retrieve.merge_results(exact, _knn(spark, sf_dir, firsts), TOP_K)


def merged_hits(spark, sf_dir):
    """The first eight hits of each question: exact ones, then the nearest chunks."""
    alike = _alike(spark, sf_dir)
    return _for_all(_merged(spark, sf_dir, _firsts(spark, sf_dir, alike)), alike)


def _kept(spark, sf_dir, alike: DataFrame) -> DataFrame:
    """What fits the context of the first of the questions in the same words."""
    merged = cut(_merged(spark, sf_dir, _firsts(spark, sf_dir, alike)))
    found = chunks(spark, sf_dir, "file", "start_line", "end_line", "symbol", "language", "text")
    hits = found.join(broadcast_within(merged, merged.count(), 64), "chunk_id")  # else the texts of all chunks are exchanged
    return answer.context_budget(hits, MAX_CHARS)


def context_budget(spark, sf_dir):
    alike = _alike(spark, sf_dir)
    kept = _kept(spark, sf_dir, alike).select("question_id", "rank", "chunk_id", F.length("text").cast("bigint").alias("n_chars"))
    return _for_all(kept, alike)


def context_text(spark, sf_dir):
    alike = _alike(spark, sf_dir)
    context = answer.context_text(_kept(spark, sf_dir, alike)).select("question_id", F.length("context").cast("bigint").alias("n_chars"), F.sha2("context", 256).alias("sha256"))
    return _for_all(context, alike)


def citations(spark, sf_dir):
    alike = _alike(spark, sf_dir)
    return _for_all(answer.citations(_kept(spark, sf_dir, alike)), alike)


def ask(spark, sf_dir):
    """Every question with its context's size and its sources, answered by the stub client's rule."""
    alike = _alike(spark, sf_dir)
    kept = cut(_kept(spark, sf_dir, alike).select("question_id", "rank", "header", "text", "file", "start_line", "end_line"))
    context = answer.context_text(kept)
    first = F.concat(F.lit("The index holds this on the question: "), F.substring_index("context", "\n", 1))
    said = context.select("question_id", first.alias("answer"), F.length("context").cast("bigint").alias("context_chars"))
    found = _for_all(said.join(answer.citations(kept), "question_id"), alike)
    return questions(spark, sf_dir).select("question_id").join(found, "question_id", "left").select("question_id", F.coalesce("answer", F.lit(answer.NOTHING_FOUND)).alias("answer"), "context_chars", "citations")


QUERIES = {
    f.__name__: f
    for f in (
        file_catalog, content_hash, skip_reason, secret_filter, ignore_patterns, binary_ratio, duplicate_content, stale_files, unchanged_files,
        to_process, parse_changes, plan_reindex, apply_changes, snapshot_files, parse_change_logs, stream_reindex, feed_index, whole_file_chunks, closing_chunks, chunk_coverage, line_chunks,
        ast_chunks, ast_chunk_lines, line_chunk_lines, snapshot_update, file_batches, index_report, tokens, hashed_embedding, embedding_norm, cosine_topk, batch_knn, query_terms, exact_symbol,
        exact_definition, exact_filename, exact_ranked, merged_hits, context_budget, context_text, citations, ask,
    )
}
