"""The index as versions of bucketed Parquet tables behind a one-line pointer.

Rows lie in buckets by a hash of their path. A version names, for each bucket, the version that wrote
it: a change writes the buckets it touches, the others stay as they are. Then the pointer is renamed
onto the version. Readers see one version throughout; a lock keeps writers apart while they move the
pointer; an old version is the way back.
"""

from __future__ import annotations

import fcntl
import json
import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae import schema
from tesserae.plans.runtime import cut

POINTER = "CURRENT"
TABLES = {"chunks": schema.CHUNKS, "file_hashes": schema.FILE_HASHES}


class SnapshotStore:
    """Versions of the tables ``chunks`` and ``file_hashes``, and of the facts about them.

    ``buckets`` is how many a new store has; more of them make a change write less.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self._new_buckets = spark, os.path.abspath(path), buckets
        os.makedirs(self.path, exist_ok=True)

    def version(self) -> int | None:
        """The current version, or None for a new store."""
        pointer = os.path.join(self.path, POINTER)
        if not os.path.exists(pointer):
            return None
        try:
            with open(pointer, encoding="utf-8") as file:
                return int(file.read().strip())
        except ValueError as error:
            raise ValueError(f"the index pointer {pointer} is damaged; build the index again") from error

    def _manifest(self) -> dict:
        """Facts of the current version, and of each table the version of each bucket that has rows."""
        version = self.version()
        if version is None:
            return {"commit_sha": None, "embed_model": None, "dim": None, "buckets": self._new_buckets, "tables": {name: {} for name in TABLES}}
        with open(os.path.join(self._folder(version), "meta.json"), encoding="utf-8") as file:
            return json.load(file)

    def meta(self) -> dict:
        """Commit, embedding model and dimension of the current version."""
        return {k: v for k, v in self._manifest().items() if k not in ("buckets", "tables")}

    def chunks(self) -> DataFrame:
        return self._table("chunks")

    def file_hashes(self) -> DataFrame:
        return self._table("file_hashes")

    def indexed_files(self) -> DataFrame:
        """``file``: paths with a hash or with chunks."""
        return self.file_hashes().select("file").union(self.chunks().select("file").filter("file is not null")).distinct()

    def commit(self, chunks: DataFrame, file_hashes: DataFrame, meta: dict) -> int:
        """Write a version with these rows and no others, and make it the current one."""
        return self._write({"chunks": chunks, "file_hashes": file_hashes}, meta, None)

    def apply(self, chunks: DataFrame, file_hashes: DataFrame, gone: DataFrame, meta: dict) -> int:
        """A version in which the files of the fresh rows are replaced and those of ``gone`` removed.

        A path in both survives. Only the buckets of these files are read and written.
        """
        count = self._manifest()["buckets"]
        touched = cut(gone.select("file").union(file_hashes.select("file")).union(chunks.select("file")).distinct())
        buckets = {r[0] for r in touched.select(_bucket(count)).distinct().collect()}
        kept = {name: self._table(name, buckets).join(touched, "file", "left_anti") for name in TABLES}
        fresh = {"chunks": chunks, "file_hashes": file_hashes}
        return self._write({name: kept[name].select(*kind.names).unionByName(fresh[name].select(*kind.names)) for name, kind in TABLES.items()}, meta, buckets)

    def _write(self, tables: dict[str, DataFrame], meta: dict, buckets: set[int] | None) -> int:
        """Write the rows of some buckets, or of all; a dimension other than the vectors' is refused before the version counts."""
        base, manifest = self.version(), self._manifest()
        version = (base or 0) + 1
        while os.path.exists(self._folder(version)):  # of a writer that gave up
            version += 1
        folder, count = self._folder(version), manifest["buckets"]
        placed: dict[str, dict[str, int]] = {}
        for name, kind in TABLES.items():
            where = os.path.join(folder, name)
            rows = tables[name].select(*kind.names, _bucket(count).alias("bucket"))
            rows.repartition(count, "bucket").write.partitionBy("bucket").parquet(where)
            old = {} if buckets is None else {b: v for b, v in manifest["tables"][name].items() if int(b) not in buckets}
            placed[name] = old | {str(b): version for b in range(count) if os.path.isdir(os.path.join(where, f"bucket={b}"))}
        written = [os.path.join(folder, "chunks", f"bucket={b}") for b, v in placed["chunks"].items() if v == version]
        sizes = [r["n"] for r in self.spark.read.parquet(*written).select(F.size("vector").alias("n")).distinct().limit(2).collect()] if written else []
        dim = meta.get("dim") if placed["chunks"] or sizes else None
        if len(sizes) > 1 or sizes and dim not in (None, sizes[0]):
            raise ValueError(f"vector dimension mismatch: the index has {dim}, the new chunks {sizes}; build the index again")
        with open(os.path.join(folder, "meta.json"), "w", encoding="utf-8") as file:
            json.dump(meta | {"dim": sizes[0] if sizes else meta.get("dim"), "buckets": count, "tables": placed}, file)
        with self.lock():
            if self.version() != base:
                raise RuntimeError("another writer changed the index")
            fresh = os.path.join(self.path, f".{POINTER}.{os.getpid()}")
            with open(fresh, "w", encoding="utf-8") as file:
                file.write(f"{version}\n")
            os.replace(fresh, os.path.join(self.path, POINTER))
        return version

    @contextmanager
    def lock(self) -> Iterator[None]:
        """Exclusive lock of the store."""
        with open(os.path.join(self.path, ".lock"), "w") as file:
            fcntl.flock(file, fcntl.LOCK_EX)
            try:
                yield
            finally:
                fcntl.flock(file, fcntl.LOCK_UN)

    def _folder(self, version: int) -> str:
        return os.path.join(self.path, f"v={version:08d}")

    def _table(self, name: str, buckets: set[int] | None = None) -> DataFrame:
        """Rows of a table, or of some of its buckets."""
        placed = self._manifest()["tables"][name]
        paths = [os.path.join(self._folder(v), name, f"bucket={b}") for b, v in placed.items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*paths)


def _bucket(count: int):
    return F.pmod(F.xxhash64("file"), F.lit(count)).cast("int")
