"""Exact dedup against a persistent index of text digests, bucketed and sorted by digest.

The index is a bucketed table: rows of equal digests lie in the same bucket and
each file is sorted, so the sort-merge anti join that finds the digests that
are new reads the index where it lies and moves only the load. New digests are
appended; texts themselves are never stored. Appending a load a second time
(after a lost driver, say) adds nothing, because its digests are known by then.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careerloom.llm.common import rows_of
from careerloom.runtime import by_bucket, cut, shared_dir

#: Digests that more than one row in so many has get their answer by a broadcast of at most so many rows.
HEAVY = 1024


def digest_of(text_col: str) -> Column:
    """SHA-256 of a whole text in UTF-8, 32 bytes; a null text counts as empty."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return F.unhex(F.sha2(text.cast("binary"), 256))


class DigestIndex:
    """``digest, keep_id``: every known text with the id of the document that keeps it.

    ``path`` is a folder that the driver and all executors share. An index that
    is already there is opened with its own number of buckets; otherwise an
    empty one is made. A bucket should hold some millions of digests (40 bytes
    each): 64 buckets do for 10^8 different texts, 16,384 for 5 * 10^10.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path
        try:
            self.buckets = spark.read.parquet(f"{path}/layout").first()["buckets"]
        except AnalysisException:
            self.buckets = buckets
            spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.parquet(f"{path}/layout")
        self.generation = self._newest()
        self._register()

    @classmethod
    def scratch(cls, spark: SparkSession, buckets: int = 64) -> DigestIndex:
        """An empty index under the cluster's shared folder."""
        return cls(spark, f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}", buckets)

    def _newest(self) -> int:
        try:
            return self.spark.read.parquet(f"{self.path}/current").agg(F.max("generation")).first()[0]
        except AnalysisException:
            return 0

    def _register(self) -> None:
        """The session's catalog may not outlive the session; the files do."""
        folder = f"{self.path}/entries-{self.generation}"
        self.table = "digest_index_" + hashlib.md5(folder.encode()).hexdigest()
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{folder}'"
        )

    def _write(self, rows: DataFrame) -> None:
        rows = by_bucket(rows.select("digest", "keep_id"), self.buckets, "digest")
        rows.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.table)

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def unknown(self, load: DataFrame) -> DataFrame:
        """``digest, keep_id`` of the load's texts that the index does not know, one row per text, the largest id."""
        # Written first: the anti join would otherwise be moved below the aggregation, where a frequent text has all its rows.
        texts = cut(load.groupBy("digest").agg(F.max("doc_id").alias("keep_id")))
        return texts.join(self.entries().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, load: DataFrame) -> None:
        """Takes in the texts of ``load`` (``digest, doc_id``) that are new."""
        self._write(self.unknown(load))

    def compact(self) -> None:
        """One file per bucket again, as a new generation; readers change over when it is complete."""
        rows = self.entries()
        self.generation += 1
        self._register()
        self._write(rows)
        now = self.spark.range(1).select(F.lit(self.generation).alias("generation"))
        now.coalesce(1).write.mode("append").parquet(f"{self.path}/current")


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = rows_of(docs, id_col, text_col)
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), digest_of(text_col).alias("digest"))


def _loads(digests: DataFrame, loads: int) -> list[DataFrame]:
    """All rows in ``loads`` ranges of the id, the largest ids first; null ids come last."""
    low, high, nulls = digests.agg(F.min("doc_id"), F.max("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    if low is None:
        return [digests]
    edges = [low + (high - low + 1) * i // loads for i in range(loads)]
    out = [digests.filter(F.col("doc_id") >= edges[-1])]
    out += [digests.filter((F.col("doc_id") >= a) & (F.col("doc_id") < b)) for a, b in zip(edges[-2::-1], edges[:0:-1])]
    return [*out, digests.filter("doc_id is null")] if nulls else out


def exact_duplicates(docs: DataFrame, index: DigestIndex, loads: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row per row of ``docs``, dropped ones too.

    ``docs`` enters the index in ``loads`` ranges of the id, the largest ids
    first, so of equal texts the largest id stays, unless the index knew the
    text before: then the id it holds stays. ``group_size`` counts the rows of
    ``docs`` with the text. A null text counts as empty. Null ids stay only
    where a text has no other. Rows that repeat an id and its text all carry
    the same answer, ``kept`` included. No rows give no rows.
    """
    digests = cut(_digests(docs, id_col, text_col))
    for load in _loads(digests, loads):
        index.append(load)
    sizes = digests.groupBy("digest").agg(F.count("*").alias("group_size"))
    groups = cut(sizes.join(index.entries().hint("merge"), "digest"))
    # A text with more than a 1,024th of all rows gets its answer by broadcast: there are at most 1,023 of them. What is
    # left has no group that a task could not hold.
    total = digests.count()
    heavy = F.broadcast(groups.filter(F.col("group_size") * HEAVY > total))
    light = groups.filter(F.col("group_size") * HEAVY <= total)
    rest = digests.join(heavy.select("digest"), "digest", "left_anti").join(light, "digest")
    answered = digests.join(heavy, "digest").unionByName(rest)
    return answered.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def new_documents(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose texts the index did not know, one per text; the index then knows them.

    Of equal texts the row with the largest id stays; of rows that repeat it, any one (they may differ in other columns).
    """
    load = docs.withColumn("__digest", digest_of(text_col)).withColumn("__id", F.col(f"`{id_col}`").cast("long"))
    fresh = cut(index.unknown(load.select(F.col("__id").alias("doc_id"), F.col("__digest").alias("digest"))))
    named = fresh.select(F.col("digest").alias("__new"), F.col("keep_id").alias("__keep"))
    kept = load.join(named, (F.col("__digest") == F.col("__new")) & F.col("__id").eqNullSafe(F.col("__keep")), "left_semi")
    out = cut(kept.dropDuplicates(["__digest"]).drop("__digest", "__id"))
    # The rows are safe before the index knows them: whoever starts again finds either both or none of them taken in.
    index._write(fresh)
    return out
