"""The change feed as a stream: files of change records in, each micro-batch applied to the index once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.plans.runtime import ensure_checkpoint_dir

FEED = "change_id bigint, repo string, ord int, status string, path string, new_path string, commit_sha string, committed_at timestamp, received_at timestamp"


def read_feed(spark: SparkSession, path: str, schema: str = FEED) -> DataFrame:
    """Change records of a folder of Parquet files, as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def latest_action(changes: DataFrame, key: tuple[str, ...] = ("repo",)) -> DataFrame:
    """``repo``, ``path``, ``action``, ``w``: the last thing that happened to each path in a batch, and when (w).

    Order is the commit's time, then the place in it; redelivered records change nothing.
    """
    when = F.struct("committed_at", "ord", "change_id")
    gone = changes.filter("status = 'D' or (status = 'R' and path <> new_path)").select(*key, "path", when.alias("w"), F.lit("delete").alias("action"))
    kept = changes.filter("status <> 'D'").select(*key, F.when(F.col("status") == "R", F.col("new_path")).otherwise(F.col("path")).alias("path"), when.alias("w"), F.lit("upsert").alias("action"))
    # Of one record, its upsert counts after its deletion.
    rows = gone.union(kept).filter("path is not null")
    return newest(rows, key)


def newest(rows: DataFrame, key: tuple[str, ...] = ("repo",)) -> DataFrame:
    """Of each path the row that happened last."""
    return rows.groupBy(*key, "path").agg(F.max(F.struct("w", "action")).alias("last")).select(*key, "path", "last.action", "last.w")


class ActionTable:
    """The last action of each path over all batches of a feed, in a folder; each batch merges into a table of its own number.

    A batch that is run again after a failure writes the same table again.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.last = spark, folder, None

    def rows(self) -> DataFrame:
        """``repo``, ``path``, ``action``, ``w``."""
        if self.last is None:
            return self.spark.createDataFrame([], "repo string, path string, action string, w struct<committed_at:timestamp,ord:int,change_id:bigint>")
        return self.spark.read.parquet(f"{self.folder}/after={self.last}")

    def apply(self, batch: DataFrame, number: int) -> None:
        """Merge a batch; for ``foreachBatch``."""
        newest(latest_action(batch).unionByName(self.rows())).write.mode("overwrite").parquet(f"{self.folder}/after={number}")
        self.last = number


class IndexedFeed:
    """Applies a feed to an index: each batch's paths, by what is known of them after it, are read, chunked and committed as one version.

    ``read(paths)`` gives rel_path, content and error of paths, which are ``repo/path``. A batch that the
    index already has, by the number kept with its version, is passed over.
    """

    def __init__(self, store, actions: ActionTable, read: Callable[[DataFrame], DataFrame], patterns: list[str], config):
        self.store, self.actions, self.read, self.patterns, self.config = store, actions, read, patterns, config

    def apply(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``."""
        from tesserae.operators.index import reindex

        self.actions.apply(batch, number)
        if (self.store.meta().get("feed_batch") or -1) >= number and self.store.version() is not None:
            return
        touched = latest_action(batch).select("repo", "path")
        now = self.actions.rows().join(touched, ["repo", "path"], "left_semi")
        status = F.when(F.col("action") == "delete", "D").otherwise("M")
        changes = now.select(status.alias("status"), F.concat_ws("/", "repo", "path").alias("path"), F.lit(None).cast("string").alias("new_path"))
        reindex(self.store, changes, self.read, self.patterns, self.config, None, None, facts={"feed_batch": number})


def run_feed(stream: DataFrame, apply: Callable[[DataFrame, int], None], name: str, checkpoint: str | None = None) -> None:
    """Apply every pending record and stop. The offset log makes a batch that was applied be passed over."""
    folder = checkpoint or f"{ensure_checkpoint_dir(stream.sparkSession)}/feed-{name}"
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination()


def counted_by_window(stream: DataFrame, width: str = "7 days", late: str = "30 days") -> DataFrame:
    """Changes by repository and window of commit time, with late records up to ``late`` behind."""
    timed = stream.withWatermark("committed_at", late)
    return timed.groupBy(F.window("committed_at", width), "repo").agg(F.count(F.lit(1)).alias("changes"))
