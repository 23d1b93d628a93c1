"""Document files -> text rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed set of extensions read as plain text, and those needing a decoder.
TEXT_EXTENSIONS = (".txt", ".md", ".markdown")
BINARY_EXTENSIONS = (".pdf", ".docx", ".doc")


def _extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def document_metadata(df: DataFrame, path: str = "path", size: str = "length") -> DataFrame:
    """filename, extension, size in bytes and in KB (two digits, half to even)."""
    return df.withColumns(
        {
            "filename": F.substring_index(path, "/", -1),
            "extension": _extension(F.col(path)),
            "size_bytes": F.col(size),
            "size_kb": F.bround(F.col(size) / F.lit(1024.0), 2),
        }
    )


def decode_text(content: Column, mode: str = "upload") -> Column:
    """UTF-8 text. Bad bytes are dropped for uploads; files fall back to Latin-1."""
    raw = content.cast("string")
    if mode == "upload":
        return F.replace(F.make_valid_utf8(raw), F.lit("�"), F.lit(""))
    return F.when(F.is_valid_utf8(raw), raw).otherwise(F.decode(content, "ISO-8859-1"))


def scan_documents(
    spark: SparkSession,
    path: str,
    mode: str = "file",
    decoder: Callable[[pd.DataFrame], pd.Series] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(documents with text, rejects with a reason) of all files under ``path``.

    ``decoder`` turns batches of binary documents into text; without one they
    are rejected, as any other unsupported type is.
    """
    files = document_metadata(
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    )
    keep = ["path", "filename", "extension", "size_bytes", "size_kb"]
    text = files.filter(F.col("extension").isin(*TEXT_EXTENSIONS)).select(
        *keep, decode_text(F.col("content"), mode).alias("text")
    )
    known = list(TEXT_EXTENSIONS)
    if decoder is not None:
        binary = files.filter(F.col("extension").isin(*BINARY_EXTENSIONS)).select(*keep, "content")
        schema = T.StructType([*text.schema.fields])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(text=decoder(pdf)).drop(columns="content")

        text = text.unionByName(binary.mapInPandas(run, schema))
        known += BINARY_EXTENSIONS
    rejects = files.filter(~F.col("extension").isin(*known)).select(
        "path", "filename", F.concat(F.lit("Unsupported file type: "), "extension").alias("reason")
    )
    return text, rejects
