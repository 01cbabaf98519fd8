"""Change logs: lines with tabs, or records with NULs, as ``git diff --name-status`` writes them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.plans.runtime import spread

_STATUS = re.compile(r"[AMDTUXB]|[RC][0-9]+")


class Change(NamedTuple):
    """One change; ``new_path`` only for renames."""

    status: str
    path: str
    new_path: str | None = None


def parse_changes(raw: str | bytes) -> list[Change]:
    """Changes of a log. A copy is an addition of its new path; paths that are not UTF-8 keep their bytes as surrogates."""
    text = raw.decode("utf-8", "surrogateescape") if isinstance(raw, bytes) else raw
    if not text:
        return []
    return _records(text) if "\0" in text else _lines(text)


def _change(status: str, paths: list[str]) -> Change:
    if status[0] == "C":
        return Change("A", paths[1])
    if status[0] == "R":
        return Change("R", paths[0], paths[1])
    return Change(status[0], paths[0])


def _records(text: str) -> list[Change]:
    error = "malformed NUL-delimited diff"
    if not text.endswith("\0"):
        raise ValueError(f"{error}: it does not end with NUL")
    fields, out, i = text[:-1].split("\0"), [], 0
    while i < len(fields):
        status = fields[i]
        if not _STATUS.fullmatch(status):
            raise ValueError(f"{error}: unknown status {status!r}")
        paths = fields[i + 1 : i + (3 if status[0] in "RC" else 2)]
        if len(paths) < (2 if status[0] in "RC" else 1) or not all(paths):
            raise ValueError(f"{error}: a path is missing after {status!r}")
        out.append(_change(status, paths))
        i += 1 + len(paths)
    return out


def _lines(text: str) -> list[Change]:
    out = []
    for line in text.splitlines():
        if line.strip():
            status, *paths = line.split("\t")
            if not status or len(paths) < (2 if status[0] in "RC" else 1):
                raise ValueError(f"malformed diff line: a path is missing in {line!r}")
            out.append(_change(status, paths))
    return out


def parse_logs(logs: DataFrame, key: str = "commit_sha", raw: str = "raw") -> DataFrame:
    """``key``, ``ord``, ``status``, ``path``, ``new_path`` of whole logs, one in each row, in either form; a damaged one is an error.

    ``raw`` is a string or binary column; a null or empty log gives no row.
    """
    kind = logs.schema[key].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, found = [], []
            for n, text in enumerate(batch.column("raw").to_pylist()):
                for at, change in enumerate(parse_changes(text or "")):
                    owners.append(n)
                    found.append((at, *readable(change)))
            columns = list(zip(*found)) or [()] * 4
            taken = batch.column("key").take(pa.array(owners, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken, *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.string(), pa.string())))], names=[key, "ord", "status", "path", "new_path"])

    return spread(logs.select(F.col(key).alias("key"), F.col(raw).alias("raw"))).mapInArrow(parse, f"`{key}` {kind}, ord int, status string, path string, new_path string")


def readable(change: Change) -> Change:
    """The change itself, if its paths are UTF-8: Spark's strings hold no others."""
    for path in (change.path, change.new_path or ""):
        try:
            path.encode("utf-8")
        except UnicodeEncodeError as error:
            raise ValueError(f"a path of the change log is not UTF-8: {path!r}") from error
    return change


def parse_lines(lines: DataFrame, column: str = "line", order: str = "ord") -> DataFrame:
    """``ord``, ``status``, ``path``, ``new_path`` of tab lines, in the JVM; blank lines give no row."""
    part = F.split(F.col(column), "\t")
    status = F.substring(part[0], 1, 1)
    rows = lines.filter(F.trim(F.coalesce(F.col(column), F.lit(""))) != "")
    return rows.select(
        F.col(order).alias("ord"),
        F.when(status == "C", "A").otherwise(status).alias("status"),
        F.when(status == "C", F.try_element_at(part, F.lit(3))).otherwise(F.try_element_at(part, F.lit(2))).alias("path"),
        F.when(status == "R", F.try_element_at(part, F.lit(3))).alias("new_path"),
    )
