"""Queries of the subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.llm import docpairs, leaks, mixing, neighbours, provenance, secrets, splitting, subjects, syntax
from tesserae.plans.runtime import table


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the oversized chunks, each chunk once, by its latest version."""
    chunks = table(spark, sf_dir, "chunks").select("chunk_id", "text", "indexed_at").filter(F.length("text") > splitting.MAX_CHARS)
    latest = chunks.groupBy("chunk_id").agg(F.max_by("text", F.struct("indexed_at", F.xxhash64("text"))).alias("text"))
    return splitting.split_oversized(latest)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that had to be split."""
    return splitting.split_oversized(table(spark, sf_dir, "chunks")).filter("piece = 0").select("chunk_id").distinct()


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar chunks of every chunk."""
    near = neighbours.nearest(table(spark, sf_dir, "chunks"))
    return near.select(F.col("id").alias("chunk_id"), "neighbour", "rank", "cosine")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks of which one is among the five nearest of the other."""
    near = neighbours.nearest(table(spark, sf_dir, "chunks"))
    return near.select(F.least("id", "neighbour").alias("chunk_a"), F.greatest("id", "neighbour").alias("chunk_b")).distinct()


def p5_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the neighbour lists of drawn vectors, against exact search among all."""
    return neighbours.measured_recall(table(spark, sf_dir, "chunks"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credentials in files, by line, and in paths of the change feed."""
    files = secrets.scan(table(spark, sf_dir, "files"), "file_id", "text")
    changes = secrets.scan(table(spark, sf_dir, "changes"), "change_id", "path", paths=True)
    in_files = files.select(F.lit("files").alias("origin"), F.col("id").alias("record_id"), "line_no")
    in_paths = changes.select(F.lit("changes").alias("origin"), F.col("id").alias("record_id"), F.lit(0).alias("line_no"))
    return in_files.unionByName(in_paths).distinct()


def p6_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with their credentials masked."""
    return secrets.masked(table(spark, sf_dir, "files").select("file_id", "repo", "name", "text"), "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of evaluation items."""
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items with the number of documents and the longest passage."""
    found = leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.max("n_words").alias("longest"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that cannot reach their target share."""
    return mixing.short_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).distinct()


def p8_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of present shares, exponentiated until they are as even as the targets are."""
    targets = table(spark, sf_dir, "mix_targets").select("source", "target_share", "max_repeats")
    shares = [r[0] for r in targets.groupBy("source").agg(F.max("target_share").alias("share")).filter("share > 0").select("share").collect()]
    return mixing.plan(mixing.sized(table(spark, sf_dir, "documents")), targets, mixing.entropy(shares)).select("source", "tokens", "max_repeats", "exponent", "weight", "budget")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached shares of the mix."""
    return mixing.mixed_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed records."""
    return mixing.mixed_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.areas(*(table(spark, sf_dir, name) for name in ("documents", "subjects", "subject_labels")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one or two subjects of each notebook."""
    return _areas(spark, sf_dir).select("doc_id", "subject").distinct()


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters by subject; a document of two subjects counts half for each."""
    share = _areas(spark, sf_dir).withColumn("share", 1 / F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    sizes = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("chars"))
    return share.join(sizes, "doc_id").groupBy("subject").agg(F.round(F.sum("share"), 3).alias("documents"), F.round(F.sum(F.col("share") * F.col("chars")), 1).alias("chars"))


def p9_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of the subjects and how they did on labelled documents left out."""
    return subjects.calibration(*(table(spark, sf_dir, name) for name in ("documents", "subjects", "subject_labels")))


def p4_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that nobody wrote by hand, with the kind found."""
    return provenance.classify(table(spark, sf_dir, "files")).select(F.col("id").alias("file_id"), "kind", "score")


def p4_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Borders of the kinds and how the classifiers did on repositories left out."""
    return provenance.validation(table(spark, sf_dir, "files"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that nobody wrote by hand."""
    return p4_kinds(spark, sf_dir).select("file_id").distinct()


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of files that do not parse, by repository and language; the latest delivery of each file counts."""
    files = table(spark, sf_dir, "files")
    last = F.max(F.struct("ingested_at", "valid", "repo", "extension")).alias("last")
    checked = syntax.check(files, keep=("repo", "ingested_at")).groupBy("id").agg(last).select("last.*")
    rates = checked.groupBy("repo", F.col("extension").alias("language"))
    return rates.agg(F.count(F.lit(1)).alias("files"), F.count_if(~F.col("valid")).alias("invalid")).withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that do not parse."""
    return syntax.check(table(spark, sf_dir, "files")).filter("not valid").select(F.col("id").alias("file_id")).distinct()


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions with their documentation, and the chunk that holds the definition."""
    pairs = docpairs.extract(table(spark, sf_dir, "files")).dropDuplicates(["id", "name", "def_line"])
    chunks = table(spark, sf_dir, "chunks").select("chunk_id", F.col("file_id").alias("id"), F.col("metadata.start_line").alias("a"), F.col("metadata.end_line").alias("b")).distinct()
    placed = pairs.join(chunks, (pairs["id"] == chunks["id"]) & pairs["def_line"].between(chunks["a"], chunks["b"]), "left")
    return placed.select(pairs["id"].alias("file_id"), "chunk_id", "name", "def_line", "code", "doc")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documented functions by file and line."""
    return docpairs.extract(table(spark, sf_dir, "files"), texts=False).select(F.col("id").alias("file_id"), "def_line").distinct()


QUERIES = {
    "p2_pairs": p2_pairs,
    "p2_found": p2_found,
    "p1_rates": p1_rates,
    "p1_found": p1_found,
    "p4_kinds": p4_kinds,
    "p4_validation": p4_validation,
    "p4_found": p4_found,
    "p9_found": p9_found,
    "p9_composition": p9_composition,
    "p9_calibration": p9_calibration,
    "p7_found": p7_found,
    "p7_items": p7_items,
    "p8_found": p8_found,
    "p8_entropy": p8_entropy,
    "p8_report": p8_report,
    "p8_mix": p8_mix,
    "p6_found": p6_found,
    "p6_masked": p6_masked,
    "p3_pieces": p3_pieces,
    "p3_found": p3_found,
    "p5_neighbours": p5_neighbours,
    "p5_recall": p5_recall,
    "p5_found": p5_found,
}

ORACLE = {
    "p3_found": "SELECT DISTINCT chunk_id FROM chunks WHERE length(text) > 3000",
}
