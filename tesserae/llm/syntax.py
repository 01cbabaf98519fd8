"""Source files that do not parse.

Each file is recognised by the grammars of the language that its extension states, all dialects in one
run; a file that every dialect rejects is flagged.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.grammars import language
from tesserae.plans.runtime import spread

#: Extensions with a grammar.
SUPPORTED = ("py", "js", "mjs", "ts", "go", "java", "rs", "c", "h", "cc", "cpp", "cxx", "hpp", "json")


@functools.lru_cache(maxsize=1024)
def _accepts(extension: str, text: str) -> bool:
    return language(extension).accepts(text) or extension == "h" and language("c").accepts(text)  # a header's words may be keywords of the other dialect


def parses(extension: str, text: str) -> bool | None:
    """Whether a text is valid for an extension; None for one without a grammar."""
    return _accepts(extension, text) if extension in SUPPORTED else None


def check(df: DataFrame, id_col: str = "file_id", name_col: str = "name", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id``, ``extension``, ``valid`` of the files whose extension has a grammar, and the columns to ``keep``.

    Extensions count in lower case. A null text or name gives no row; an empty text is valid, but for
    JSON. A repeated row gives its row again. Only the three named columns and those to keep are read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    extension = F.lower(F.regexp_extract(F.col(name_col), r"[^/]\.([A-Za-z]+)$", 1))
    rows = df.select(F.col(id_col).alias("id"), extension.alias("extension"), F.col(text_col).alias("text"), *keep).filter(F.col("extension").isin(*SUPPORTED) & F.col("text").isNotNull())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            extensions = batch.column("extension")
            valid = [_accepts(e, t) for e, t in zip(extensions.to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), extensions, pa.array(valid, pa.bool_()), *(batch.column(c) for c in keep)], names=["id", "extension", "valid", *keep])

    kept = "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return spread(rows).mapInArrow(judge, f"id {kind}, extension string, valid boolean{kept}")
