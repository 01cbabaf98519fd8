"""Command line: ``index``, ``reindex`` and ``ask``."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import replace

from pyspark.sql import functions as F

from tesserae.functions.columns import cosine, result_key
from tesserae.operators import answer, index, retrieve, rules
from tesserae.operators.embed import EmbeddingError, embed_texts
from tesserae.plans.runtime import local_session
from tesserae.settings import Settings, load_settings
from tesserae.sources.changes import parse_changes, readable
from tesserae.sources.git import commit_state
from tesserae.sources.repo_tree import read_files, read_tree
from tesserae.sources.snapshot import SnapshotStore


def _positive(text: str) -> int:
    value = int(text)
    if value <= 0:
        raise argparse.ArgumentTypeError("must be positive")
    return value


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tesserae", description="Index a source tree and answer questions about it.")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("index", help="bring the index up to the tree").add_argument("repo")
    again = commands.add_parser("reindex", help="apply the changes of one commit")
    again.add_argument("--repo", required=True)
    again.add_argument("--changed-files", required=True, help="output of git diff --name-status, with tabs or NULs")
    ask = commands.add_parser("ask", help="answer a question from the index")
    ask.add_argument("question")
    ask.add_argument("--repo", default=".")
    ask.add_argument("--top-k", type=_positive)
    return parser


def _patterns(root: str) -> list[str]:
    path = os.path.join(root, rules.IGNORE_FILE)
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8", errors="ignore") as file:
        return sorted(rules.read_patterns(file.read()))


def _existing(settings: Settings) -> str:
    if not os.path.exists(settings.index_path / "CURRENT"):
        raise ValueError(f"no index at {settings.index_path}; run index first")
    return str(settings.index_path)


def run_index(spark, settings: Settings) -> dict:
    root = str(settings.repo_root)
    head = commit_state(root)[0]
    store = SnapshotStore(spark, str(settings.index_path))
    return index.index_tree(store, read_tree(spark, root), _patterns(root), settings.embedding, head, lambda paths: read_files(paths, root), lambda: read_tree(spark, root, contents=False), lambda: commit_state(root)[0])


def run_reindex(spark, settings: Settings, raw: bytes) -> dict:
    root = str(settings.repo_root)
    head, parent = commit_state(root)
    rows = [(i, *readable(c)) for i, c in enumerate(parse_changes(raw))]
    changes = spark.createDataFrame(rows, "ord int, status string, path string, new_path string")
    return index.reindex(SnapshotStore(spark, _existing(settings)), changes, lambda paths: read_files(paths, root), _patterns(root), settings.embedding, head, parent, lambda: commit_state(root)[0])


def run_ask(spark, settings: Settings, question: str, client: answer.ModelClient | None = None) -> str:
    """Retrieval for one question is one plan over the chunks; the bounded context comes to the driver."""
    store = SnapshotStore(spark, _existing(settings))
    dim = store.meta().get("dim")
    config = replace(settings.embedding, dim=dim) if settings.embedding.provider == "hashed" and dim else settings.embedding
    vector = embed_texts([question], config)[0]
    asked = spark.createDataFrame([(0, question, vector)], "question_id bigint, question string, vector array<double>")
    kept = retrieve_context(asked, store.chunks(), settings.top_k, settings.max_context_chars)
    if kept.isEmpty():
        return answer.NOTHING_FOUND if store.chunks().isEmpty() else answer.answer(question, kept, answer.StubClient())
    client = client or (answer.HttpClient(settings.endpoint, settings.model or "default", max_tokens=settings.max_output_tokens) if settings.endpoint else answer.StubClient())
    return answer.answer(question, kept, client)


def retrieve_context(asked, chunks, top_k: int, max_chars: int):
    """Chunks for the prompts of ``asked(question_id, question, vector)``, exact hits before vector hits."""
    chunks = chunks.withColumn("chunk_id", result_key(*map(F.col, ("chunk_id", "file", "start_line", "end_line", "symbol", "text"))))
    terms = retrieve.query_terms(asked)
    found = retrieve.exact_matches(terms, chunks.select("chunk_id", "file", "symbol", "text"))
    scored = found.join(chunks.select("chunk_id", "file", "start_line", "vector"), "chunk_id").join(F.broadcast(asked.select("question_id", F.col("vector").alias("qv"))), "question_id")
    exact = scored.select("question_id", "chunk_id", "match", F.round(cosine(F.col("qv"), F.col("vector")), 9).alias("score"), "file", "start_line")
    near = retrieve.nearest(asked, chunks, top_k, "question_id", "seq").join(chunks.select("seq", "chunk_id"), "seq").select("question_id", "chunk_id", "score", "rank")
    merged = retrieve.merge_results(exact, near, top_k)
    hits = merged.join(chunks.select("chunk_id", "file", "start_line", "end_line", "symbol", "language", "text"), "chunk_id")
    return answer.context_budget(hits, max_chars)


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    root = args.repo
    try:
        if not os.path.isdir(root):
            raise ValueError(f"no such directory: {root}")
        settings = load_settings(root, top_k=getattr(args, "top_k", None))
        spark = local_session()
        spark.sparkContext.setLogLevel("ERROR")
        if args.command == "index":
            report = run_index(spark, settings)
        elif args.command == "reindex":
            with open(args.changed_files, "rb") as file:
                report = run_reindex(spark, settings, file.read())
        else:
            print(run_ask(spark, settings, args.question))
            return 0
        for row in report.pop("removed").toLocalIterator() if "removed" in report else ():
            print(f"removed {row['file']}")
        if not report.pop("commit_moved", True):
            print("tesserae: errors, or HEAD changed during the run; the commit of the index stays", file=sys.stderr)
        print(", ".join(f"{k} {v}" for k, v in report.items()))
        return 1 if report.get("errors") else 0
    except (ValueError, RuntimeError, EmbeddingError, OSError) as error:
        print(f"tesserae: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
