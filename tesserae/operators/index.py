"""Keeping an index up to date: what is stale, unchanged or new, and applying replacements and deletions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.chunking import chunk_files
from tesserae.operators.embed import EmbeddingConfig, EmbeddingError, with_vectors
from tesserae.operators.rules import skip_reason
from tesserae.plans.runtime import cut, global_rank
from tesserae.sources.snapshot import SnapshotStore


def stale(indexed: DataFrame, current: DataFrame, key: str | list[str] = "file") -> DataFrame:
    """Indexed files that are gone."""
    return indexed.join(current, key, "left_anti")


def unchanged(current: DataFrame, hashes: DataFrame, key: list[str]) -> DataFrame:
    """Current files whose hash is in the index; ``key`` holds the path and hash columns."""
    return current.join(hashes, key, "left_semi")


def to_process(current: DataFrame, hashes: DataFrame, key: list[str]) -> DataFrame:
    """Current files that are new or have another hash."""
    return current.join(hashes, key, "left_anti")


def apply_changes(table: DataFrame, fresh: DataFrame, deleted: DataFrame, key: str = "file") -> DataFrame:
    """``table`` without the deleted and replaced files, then the fresh rows. Deletions come first: a path in both survives."""
    gone = deleted.select(key).union(fresh.select(key)).distinct()
    return table.join(gone, key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def ordered(chunks: DataFrame, path: str = "file", position: str = "pos", after: int = 0) -> DataFrame:
    """``chunks`` with a ``seq`` that grows with path components, then position in the file; numbers have gaps."""
    rows = chunks.orderBy(F.split(F.col(path), "/"), path, position)
    return rows.withColumn("seq", F.lit(after) + F.monotonically_increasing_id())


def file_batches(files: DataFrame, path: str = "rel_path", size: int = 32) -> DataFrame:
    """``files`` with the number of their batch, in the order of path components."""
    ranked = global_rank(files, [F.split(F.col(path), "/"), F.col(path)], "place")
    return ranked.withColumn("batch", F.floor((F.col("place") - 1) / size).cast("int")).drop("place")


def plan_changes(changes: DataFrame, present: DataFrame, indexable: DataFrame | None = None) -> DataFrame:
    """``path``, ``action`` of a change list: ``delete`` or ``upsert``, each path at most once for each.

    A deletion and the old path of a rename delete. A target that is not present is passed over and its
    chunks stay; one that may not be indexed is deleted; any other status upserts.
    """
    moved = changes.filter((F.col("status") == "R") & (F.col("path") != F.col("new_path"))).select("path")
    gone = changes.filter("status = 'D'").select("path").union(moved)
    target = changes.filter("status <> 'D'").select(F.when(F.col("status") == "R", F.col("new_path")).otherwise(F.col("path")).alias("path")).distinct()
    there = target.join(present.select("path").distinct(), "path", "left_semi")
    keep = there.join(indexable.select("path").distinct(), "path", "left_semi") if indexable is not None else there
    hidden = there.join(indexable.select("path").distinct(), "path", "left_anti") if indexable is not None else there.limit(0)
    return gone.union(hidden).distinct().withColumn("action", F.lit("delete")).union(keep.withColumn("action", F.lit("upsert")))


def chunked(files: DataFrame, config: EmbeddingConfig, after: int = 0) -> tuple[DataFrame, DataFrame]:
    """Chunk rows with ids, order and vectors for ``files(file, file_hash, content)``; and ``file``, ``error`` of those that could not be embedded.

    A file of which one text fails has no rows; the others are not held up by it.
    """
    made = chunk_files(files, "file", "content", keep=("file_hash",))
    made = made.withColumn("chunk_id", F.sha2(F.concat_ws("\x01", "file", F.col("start_line").cast("string"), F.col("end_line").cast("string"), "file_hash"), 256))
    rows = cut(with_vectors(ordered(made, after=after), "chunk_id", "text", config, isolate="file").drop("pos", "file_hash"))
    failed = cut(rows.filter("embed_error is not null").groupBy("file").agg(F.min("embed_error").alias("error")))
    return rows.drop("embed_error").join(failed.select("file"), "file", "left_anti"), failed


def _next_seq(chunks: DataFrame) -> int:
    last = chunks.agg(F.max("seq")).first()[0]
    return 0 if last is None else last + 1


def index_tree(store: SnapshotStore, tree: DataFrame, patterns: list[str], config: EmbeddingConfig, commit_sha: str | None, read: Callable[[DataFrame], DataFrame] | None = None, relist: Callable[[], DataFrame] | None = None, head: Callable[[], str | None] | None = None) -> dict:
    """Bring an index up to a tree; a report of counts.

    ``tree`` has rel_path, content and error; each content is read once to be judged and hashed, and
    only what is new or changed is read again, by ``read(paths)``, and chunked with the hash of what was
    read then. Files that ``relist()`` no longer has, or that cannot be read any more, are taken out of the index.
    Unreadable files, and those that could not be embedded, keep what the index has of them. The commit
    marker moves only without errors and if ``head()`` is still the commit. A change of model embeds everything again.
    """
    meta = store.meta()
    fine = F.col("error").isNull()
    reason = F.when(fine, skip_reason(F.col("rel_path"), F.col("content"), patterns))
    seen = cut(tree.select(F.col("rel_path").alias("file"), "error", F.when(fine, F.sha2("content", 256)).alias("file_hash"), reason.alias("reason")))
    current = seen.filter("error is null and reason is null").select("file", "file_hash")
    unreadable = seen.filter("error is not null").select("file", "error")
    same_model = meta.get("embed_model") in (None, config.model) and meta.get("dim") in (None, config.dim)
    hashes = store.file_hashes() if same_model else store.file_hashes().limit(0)
    wanted = cut(to_process(current, hashes, ["file", "file_hash"]).select("file"))
    content = (read or (lambda paths: tree.join(paths, "rel_path", "left_semi")))(wanted.withColumnRenamed("file", "rel_path"))
    taken = cut(content.select(F.col("rel_path").alias("file"), F.when(fine, F.sha2("content", 256)).alias("file_hash"), "content", "error"))
    fresh = taken.filter("error is null").drop("error")
    chunks, failed = chunked(fresh, config, _next_seq(store.chunks()) if same_model else 0)
    indexed = fresh.select("file", "file_hash").join(failed.select("file"), "file", "left_anti")
    vanished = wanted.join(fresh.select("file"), "file", "left_anti")
    if relist is not None:
        vanished = vanished.union(current.select("file").join(relist().select(F.col("rel_path").alias("file")), "file", "left_anti")).distinct()
    vanished = cut(vanished)
    stale_files = cut(stale(store.indexed_files(), current.select("file")).join(unreadable.select("file"), "file", "left_anti"))
    late = vanished.withColumn("late", F.lit(True))
    chunks = chunks.join(late, "file", "left_anti")
    indexed = indexed.join(late, "file", "left_anti")
    facts = {"embed_model": config.model, "dim": config.dim}
    errors = unreadable.count() + failed.count()
    sha = commit_sha if not errors and (head is None or head() == commit_sha) else meta.get("commit_sha")
    if same_model:
        store.apply(chunks, indexed, stale_files.union(vanished), {"commit_sha": sha, **facts})
    else:
        store.commit(chunks, indexed, {"commit_sha": sha, **facts})
    report = {"scanned": current.count(), "to_index": wanted.count(), "stale": stale_files.count(), "vanished": vanished.count(), "errors": errors}
    report["unchanged"] = report["scanned"] - report["to_index"]
    report["chunks"] = store.chunks().count()
    report["commit_moved"] = sha == commit_sha
    return report


def reindex(store: SnapshotStore, changes: DataFrame, read: Callable[[DataFrame], DataFrame], patterns: list[str], config: EmbeddingConfig, head: str | None, parent: str | None, head_now: Callable[[], str | None] | None = None, facts: dict | None = None) -> dict:
    """Apply one commit's changes. The index must be at its parent; nothing is written before all is chunked and embedded.

    Only the changed paths are read, by ``read(paths)``; one that is not there has an error. A failed
    embedding, or another HEAD by ``head_now()`` at the end, stops the run, and the index stays as it was.
    ``removed`` of the report are the paths deleted, in order. ``facts`` are kept with the version.
    """
    meta = store.meta()
    if head is not None and meta.get("commit_sha") != parent:
        raise ValueError(f"index base commit mismatch: index is at {meta.get('commit_sha') or 'unknown'}, but HEAD is based on {parent or 'no parent'}")
    target = changes.filter("status <> 'D'").select(F.when(F.col("status") == "R", F.col("new_path")).otherwise(F.col("path")).alias("rel_path")).distinct()
    content = read(target).filter("error is null")
    taken = cut(content.select(F.col("rel_path").alias("path"), F.sha2("content", 256).alias("file_hash"), "content", skip_reason(F.col("rel_path"), F.col("content"), patterns).alias("reason")))
    plan = cut(plan_changes(changes, taken.select("path"), taken.filter("reason is null").select("path")))
    deleted = plan.filter("action = 'delete'").select(F.col("path").alias("file"))
    upserts = taken.join(plan.filter("action = 'upsert'").select("path"), "path", "left_semi").select(F.col("path").alias("file"), "file_hash", "content")
    fresh = cut(to_process(upserts, store.file_hashes(), ["file", "file_hash"]))
    chunks, failed = chunked(fresh, config, _next_seq(store.chunks()))
    problem = failed.orderBy("file").first()
    if problem is not None:
        raise EmbeddingError(f"{problem['file']}: {problem['error']}")
    if head_now is not None and head_now() != head:
        raise RuntimeError("HEAD changed during the run; the index was not updated")
    store.apply(chunks, fresh.select("file", "file_hash"), deleted, meta | {"commit_sha": head, "embed_model": config.model} | (facts or {}))
    report = {"deleted": deleted.count(), "upserts": upserts.count(), "reindexed": fresh.count()}
    report["skipped"] = report["upserts"] - report["reindexed"]
    report["removed"] = deleted.orderBy("file")
    return report
