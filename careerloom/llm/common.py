"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space that separates words, as a class of a regular expression.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of rows that a task hands to Python at once.
BATCH_BYTES = 4 << 20


def rows_of(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra columns of any name are harmless."""
    return docs.select(*(F.col(f"`{c}`") for c in columns))


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text with A-Z in lower case. ``bytes.split`` splits at exactly 0x20 and 0x09-0x0D."""
    return text.lower().split() if text else []


def bucket(column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def batches_of(
    rows: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` under one name for all operators, on batches of bounded bytes.

    Ten thousand rows of text, Spark's own bound, are tens of megabytes in the executor and again in its Python worker.
    The setting is the session's. A worker outlives its tasks, so what a task has freed goes back to the system at its end.
    """
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return rows.mapInArrow(run, schema)


def give_back() -> None:
    """Freed memory that the allocators of Arrow and of the C library still hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int) -> DataFrame:
    """``doc_id, text, label`` of at most ``max_rows`` labelled documents, chosen by a hash of the id.

    Labels other than 0 and 1 are left out; of several labels of an id the smallest counts, of several texts the one
    with the smallest hash.
    """
    chosen = (
        rows_of(labels, "doc_id", label_col)
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .filter("doc_id is not null and label in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    # At most max_rows small rows: a proven bound for the broadcast.
    return (
        rows_of(docs, "doc_id", "text")
        .select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
        .select("doc_id", "text", "label")
    )


def fitted(sample: DataFrame, features: Callable, train: Callable):
    """The model that one task fits on a bounded sample; only the model, of fixed size, reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [], []
        for batch in batches:
            rows.extend(features(t.as_py()) for t in batch.column("text"))
            labels.extend(batch.column("label").to_pylist())
        model = train(rows, np.array(labels, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # Rows in an order that has nothing to do with where they lie.
    rows = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    made = batches_of(rows, run, "model binary").collect()
    # An empty sample may have no task at all.
    return pickle.loads(made[0]["model"]) if made else train([], np.empty(0, np.int64))


def scored(rows: DataFrame, id_col: str, text_col: str, model) -> DataFrame:
    """``doc_id, score`` by ``model.score``; the model's size is fixed by its parameters, so it is broadcast."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    rows = rows.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shared.value.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return batches_of(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
