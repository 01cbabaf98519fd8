"""Explicit schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

CHUNKS = T.StructType([
    T.StructField("chunk_id", T.StringType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("file", T.StringType()),
    T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("vector", T.ArrayType(T.DoubleType())),
])
FILE_HASHES = T.StructType([T.StructField("file", T.StringType(), False), T.StructField("file_hash", T.StringType(), False)])
