"""A source tree as a DataFrame, through a Python data source.

Spark's own file sources drop names that begin with ``.`` or ``_``; this one reads every file. Ignored
directories are not entered. Each directory below the root is one partition of the scan.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tesserae.operators.rules import IGNORED_DIRS
from tesserae.plans.runtime import ensure_importable, spread

_ARROW = pa.schema([("rel_path", pa.string()), ("content", pa.binary()), ("n_bytes", pa.int64()), ("error", pa.string())])


class _Part(InputPartition):
    def __init__(self, files: list[tuple[str, str | None]]):
        self.files = files


class _Reader(DataSourceReader):
    """Lists on the driver, which sees names only; reads on the executors, which must see the same path."""

    def __init__(self, root: str, files_per_partition: int, contents: bool):
        self.root, self.size, self.contents = root, files_per_partition, contents

    def partitions(self) -> list[_Part]:
        listed: list[tuple[str, str | None]] = []

        def failed(error: OSError) -> None:
            listed.append((os.path.relpath(error.filename or self.root, self.root), str(error)))

        for folder, dirs, names in os.walk(self.root, onerror=failed):
            dirs[:] = sorted(d for d in dirs if d not in IGNORED_DIRS)
            for name in sorted(names):
                path = os.path.join(folder, name)
                if os.path.isfile(path):
                    listed.append((os.path.relpath(path, self.root).replace(os.sep, "/"), None))
        return [_Part(listed[i : i + self.size]) for i in range(0, len(listed), self.size)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        for path, error in partition.files:
            yield _row(self.root, path, error) if self.contents else pa.RecordBatch.from_pydict({"rel_path": [path], "content": [None], "n_bytes": [None], "error": [error]}, schema=_ARROW)


def _row(root: str, path: str, error: str | None = None) -> pa.RecordBatch:
    """The row of one file; an error instead of the content of one that cannot be read or is none."""
    content = None
    if error is None:
        try:
            with open(os.path.join(root, path), "rb") as file:
                content = file.read()
        except OSError as failure:
            error = str(failure)
    return pa.RecordBatch.from_pydict({"rel_path": [path], "content": [content], "n_bytes": [None if content is None else len(content)], "error": [error]}, schema=_ARROW)


class RepoTree(DataSource):
    """``spark.read.format("repo_tree").option("path", root).load()``: rel_path, content, n_bytes, error."""

    @classmethod
    def name(cls) -> str:
        return "repo_tree"

    def schema(self) -> str:
        return "rel_path string, content binary, n_bytes bigint, error string"

    def reader(self, schema) -> DataSourceReader:
        root = self.options.get("path")
        if not root or not os.path.isdir(root):
            raise ValueError(f"no such directory: {root}")
        return _Reader(os.path.abspath(root), int(self.options.get("filesPerPartition", "256")), self.options.get("contents", "true") == "true")


def read_tree(spark: SparkSession, root: str, files_per_partition: int = 256, contents: bool = True) -> DataFrame:
    """The files of a tree; unreadable ones have an error instead of content. Without ``contents``, they are only listed."""
    ensure_importable(spark)
    spark.dataSource.register(RepoTree)
    return spark.read.format("repo_tree").option("path", root).option("filesPerPartition", str(files_per_partition)).option("contents", str(contents).lower()).load()


def read_files(paths: DataFrame, root: str) -> DataFrame:
    """The files that ``paths(rel_path)`` names, without listing the tree; one that is not there has an error."""
    base = os.path.abspath(root)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("rel_path").to_pylist():
                yield _row(base, path)

    return spread(paths.select("rel_path")).mapInArrow(read, RepoTree.schema(None))
