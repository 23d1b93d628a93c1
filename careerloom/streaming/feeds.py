"""Status feeds, upload deduplication and incremental rebuilds as streams.

events:  session_id, document_id, event, ts, payload
Every job takes a checkpoint folder; results land in tables that can be re-read
after a restart.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from careerloom.operators.common import KEY
from careerloom.runtime import cut
from careerloom.sources.versions import VersionedTables
from careerloom.streaming.status import EVENT_STATUS, current_status, stream_document_status  # noqa: F401

def status_of(event: Column) -> Column:
    return F.coalesce(*[F.when(event == e, F.lit(s)) for e, s in EVENT_STATUS.items()])


def document_status(events: DataFrame) -> DataFrame:
    """Latest status per document, batch or stream (an unbounded key state of one row each)."""
    row = F.struct(F.col("ts"), F.col("event_id"))
    return events.groupBy(KEY, "document_id").agg(
        F.max_by(status_of(F.col("event")), row).alias("status"),
        F.max("ts").alias("last_ts"),
        F.count("*").alias("n_events"),
    )


def _bloom_words(keys: DataFrame, sizes: list[tuple[int, int]], hashes: int) -> DataFrame:
    """``k, version, word, mask``: for every key and filter the bits that the key sets, by 64-bit word.

    ``sizes``: version and number of words of each filter, a driver-sized list.
    """
    filters = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.lit(n).alias("words")) for v, n in sizes]))
    bits = keys.select("k", filters.alias("f"), F.explode(F.array(*map(F.lit, range(hashes)))).alias("i"))
    bit = F.pmod(F.xxhash64("k", "i"), F.col("f.words") * 64)
    bits = bits.select("k", "f.version", F.floor(bit / 64).cast("long").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("bit"))
    return bits.groupBy("k", "version", "word").agg(F.bit_or("bit").alias("mask"))


def stream_dedup_uploads(
    uploads: DataFrame, path: str, checkpoint: str, order: Sequence[str] = ("upload_ts", "document_id"), bits_per_key: int = 10, hashes: int = 7
) -> StreamingQuery:
    """First upload of each content per session, however long ago it was; of equal times the smallest document.

    What was taken before is a table next to the stream, not state. Every
    stored batch comes with a Bloom filter of its contents; a new batch asks the
    filters, opens only the batches that may have some of its contents, and
    takes out those that they do have. A replayed batch is left as it was.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        tables = VersionedTables(spark, path, (KEY, "file_hash"))
        row = F.struct(*batch.columns)
        firsts = cut(batch.groupBy(KEY, "file_hash").agg(F.min_by(row, F.struct(*order)).alias("r")).select("r.*"))
        content = firsts.select(F.xxhash64(KEY, "file_hash").alias("k"), KEY, "file_hash")
        before = {v: c for v, c in tables.commits().items() if v < batch_id}
        maybe = may_hold(spark, path, before, content, hashes)
        if maybe:
            stored = [f"{path}/{before[v][0]}/uploads" for v in maybe]
            known = spark.read.parquet(*stored).select(KEY, "file_hash")
            firsts = cut(firsts.join(known, [KEY, "file_hash"], "left_anti"))
        words = max(1, math.ceil(firsts.count() * bits_per_key / 64))
        kept = firsts.select(F.xxhash64(KEY, "file_hash").alias("k"))
        bloom = _bloom_words(kept, [(batch_id, words)], hashes).groupBy("word").agg(F.bit_or("mask").alias("bits"))
        tables.commit(batch_id, firsts, note=str(words), uploads=firsts, bloom=bloom)

    return (
        uploads.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def may_hold(spark, path: str, commits: dict, content: DataFrame, hashes: int = 7) -> list[int]:
    """The versions whose filter has all bits of at least one key ``k`` of ``content``."""
    if not commits:
        return []
    sizes = [(v, int(c[2])) for v, c in commits.items()]
    version = F.regexp_extract(F.col("_metadata.file_path"), r"/v(\d+)-[0-9a-f]+/bloom/", 1).cast("long")
    filters = spark.read.parquet(*[f"{path}/{c[0]}/bloom" for c in commits.values()]).select(version.alias("version"), "word", "bits")
    asked = _bloom_words(content.select("k").distinct(), sizes, hashes)
    hit = asked.join(filters, ["version", "word"], "left").groupBy("k", "version").agg(
        F.min(F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False))).alias("all")
    )
    return sorted(r.version for r in hit.filter("all").select("version").distinct().collect())


def first_uploads(spark, path: str) -> DataFrame:
    return VersionedTables(spark, path, (KEY, "file_hash")).read("uploads")


def event_counts(events: DataFrame, width: str = "1 hour", delay: str | None = "10 minutes") -> DataFrame:
    """Events per kind and window, and the documents that had one.

    Two aggregations, one above the other: per document in a window, then per window. A window's documents are so never
    held as a set, on a stream neither.
    """
    df = events.withWatermark("ts", delay) if delay else events
    each = df.groupBy(F.window("ts", width).alias("w"), "event", KEY, "document_id").agg(F.count("*").alias("n"))
    return each.groupBy(F.window("w", width).alias("w"), "event").agg(F.sum("n").alias("n_events"), F.count("*").alias("n_documents")).select(
        F.col("w.start").alias("window_start"), "event", "n_events", "n_documents"
    )


def stream_event_counts(
    events: DataFrame, path: str, checkpoint: str, width: str = "1 hour", delay: str = "10 minutes"
) -> StreamingQuery:
    """Closed windows only: append mode behind the watermark."""
    return (
        event_counts(events, width, delay)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_rebuild(
    finished: DataFrame, rebuild: Callable[[DataFrame], dict[str, DataFrame]], path: str, checkpoint: str,
    completed: Callable[[], DataFrame] | None = None, min_documents: int = 2,
) -> StreamingQuery:
    """Recompute the sessions that a batch of finished documents touched, all their tables at once.

    ``rebuild`` maps touched session ids to the sessions' full new tables, by
    name: labels, triples, insights. ``completed`` gives the completed documents;
    sessions with fewer than ``min_documents`` wait. The tables of a batch count
    from the moment it is committed, together (``VersionedTables``).
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        touched = batch.select(KEY).distinct()
        if completed is not None:
            ready = completed().groupBy(KEY).agg(F.count("*").alias("n")).filter(F.col("n") >= min_documents)
            touched = touched.join(ready, KEY, "left_semi")
        touched = cut(touched)
        VersionedTables(batch.sparkSession, path).commit(batch_id, touched, **rebuild(touched))

    return (
        finished.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_rows(spark, path: str, name: str = "triples") -> DataFrame:
    """Every session's rows as of its newest committed rebuild."""
    return VersionedTables(spark, path).read(name)
