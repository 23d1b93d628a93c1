import re

import pyarrow as pa
from pyspark.sql import functions as F

from careerloom.llm import bpe, mixing


def test_encoded_rows_leave_in_small_batches():
    """Ten megabytes of rows are at least five batches, and no row is lost."""
    add = bpe._flushed(["n", "ids"], [pa.int64(), pa.binary()])
    rows = [(i, bytes(100_000)) for i in range(100)]
    batches = [b for row in rows for b in add(row, len(row[1]))] + list(add(None))
    assert [n for b in batches for n in b.column("n").to_pylist()] == list(range(100))
    assert max(b.nbytes for b in batches) < 2 * bpe.OUT_BYTES and len(batches) >= 5


def test_blocks_of_the_mix_are_never_broadcast(spark):
    """The optimiser sees the few draws that the blocks come of, not the blocks."""
    docs = spark.range(2000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 200).alias("text"), F.lit("s").alias("source"), F.col("id").alias("__row")
    )
    plan = mixing.pieces(mixing.plan(docs))._jdf.queryExecution().sparkPlan().toString()
    assert re.search(r"SortMergeJoin \[sid#\d+, blk#\d+L\]", plan)
