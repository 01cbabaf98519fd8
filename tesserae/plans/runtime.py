"""Session helpers: table access, lineage cuts and partition spreading."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Largest side, in bytes of raw data, that the engine broadcasts by hint.
BROADCAST_BYTES = 64 << 20


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    That covers local sessions and clusters with a shared folder; elsewhere the package is shipped with
    ``--py-files`` as any other.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *known])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    ensure_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset, as in local tests, a
    temporary folder of this machine is made and used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if named:
        if current is None:
            context.setCheckpointDir(named)
        return named
    if current is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tesserae-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def temporary(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder, removed when the driver's JVM ends."""
    path = f"{ensure_checkpoint_dir(spark)}/tesserae-{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: its lineage ends there.

    A table is written rather than an RDD, as columns compress. A lost executor costs nothing that
    was written. The table goes when the driver ends.
    """
    path = temporary(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_within(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its rows, of about so many bytes each, are known to fit; else as it is, for a join by exchange."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    A file with one row group is one task whatever the number of cores. Rows are dealt out round
    robin only in that case; otherwise the scan's own partitions stay and nothing is shuffled. A plan
    with exchanges is left as it is: its partitions are known only once they ran.
    """
    ensure_importable(df.sparkSession)
    execution = df._jdf.queryExecution()
    if "Adaptive" in execution.executedPlan().getClass().getSimpleName():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = execution.toRdd().getNumPartitions()
    return df if parts >= cores else df.repartition(cores)


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the place of each row in a total order, from 1.

    Rows are ranked within ranges of the order, whose counts are summed; no task sees more than a range.
    """
    ranged = cut(df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + within).drop("__part", "__before")


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def local_session(cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests, benchmarks and the command line."""
    cpus = cpus or os.cpu_count() or 2
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tesserae")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
