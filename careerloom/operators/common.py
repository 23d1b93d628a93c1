"""Shared relational idioms that stay balanced when one key holds most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careerloom.runtime import cut, cut_by

KEY = "session_id"


def first_by(df: DataFrame, keys: Sequence[str], value: Column, order: Sequence[Column | str], name: str) -> DataFrame:
    """One row per key with the ``value`` of the first row in ``order``.

    An aggregate instead of a ranking window: it combines before the shuffle,
    so a hot key never sits in one task.
    """
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(name))


def canonical_map(df: DataFrame, keys: Sequence[str], id_col: str, order: Sequence[Column | str]) -> DataFrame:
    """(session_id, id, canonical_id): every id mapped to the first id of its key."""
    firsts = first_by(df, [KEY, *keys], F.col(id_col), order, "canonical_id")
    return (
        df.select(KEY, *keys, F.col(id_col).alias("id"))
        .join(firsts, [KEY, *keys])
        .groupBy(KEY, "id")
        .agg(F.min("canonical_id").alias("canonical_id"))
    )


def resolve_chains(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Follow src -> dst links to their ends by pointer doubling, chains and cycles of any length.

    A cycle is broken at its smallest member, which then has no link of its
    own. ``links`` needs one row per (keys, src). Links that have reached their
    end are set aside; the rest doubles its reach every round. What is left once
    the reach covers the longest group of open links leads into a cycle, and the
    smallest member seen from there is the cycle's.
    """
    columns = [*keys, "src", "dst", "lo"]
    current = cut(links.select(*keys, "src", "dst", F.col("dst").alias("lo")))
    settled, reach = current.limit(0), 1
    while True:
        known = current.unionByName(settled)
        onward = known.select(*keys, F.col("src").alias("dst"), F.col("dst").alias("dst2"), F.col("lo").alias("lo2"))
        stepped = cut(
            current.join(onward, [*keys, "dst"], "left").select(
                *keys,
                "src",
                F.coalesce("dst2", "dst").alias("dst"),
                F.least("lo", F.coalesce("lo2", "lo")).alias("lo"),
                F.col("dst2").isNotNull().alias("open"),
            )
        )
        settled = settled.unionByName(stepped.filter("not open").select(columns))
        current = stepped.filter("open").select(columns)
        longest = current.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if longest is None:
            return settled.filter("src <> dst").select(*keys, "src", "dst")
        reach *= 2
        if reach > 2 * longest:
            break
    ends = current.select(*keys, F.col("src").alias("dst"), F.col("lo").alias("cycle_min"))
    cyclic = current.join(ends, [*keys, "dst"], "left").select(*keys, "src", F.coalesce("cycle_min", "dst").alias("dst"))
    return settled.select(*keys, "src", "dst").unionByName(cyclic).filter("src <> dst")


def keep(df: DataFrame, buckets: int, placed: bool = False) -> DataFrame:
    """``cut`` into a table bucketed by session.

    What is made of such tables lies by session too, and Spark leaves the exchange out. ``placed``: a union of
    such frames, whose place Spark does not always see.
    """
    return cut_by(df if placed else df.repartition(buckets, KEY), KEY, buckets=buckets, placed=True, codec="zstd")


def stored(df: DataFrame, buckets: int | None, placed: bool = False) -> DataFrame:
    """A table by session where ``buckets`` are given, else any table."""
    return cut(df) if buckets is None else keep(df, buckets, placed)


def digits_first(number: Column) -> Column:
    """Text that sorts like the number, however long: the count of its digits, then the digits."""
    text = number.cast("string")
    return F.concat(F.lpad(F.length(text).cast("string"), 2, "0"), text)


def previous_row(
    df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[str], cols: Sequence[str], name: str = "prev"
) -> DataFrame:
    """``lag`` that does not put a whole key into one task.

    ``chunk`` must rise with ``order`` (a month of the ordering date, say). The
    window runs inside (keys, chunk); the first row of a chunk takes the last
    row of the chunk before it, found on a table with one row per chunk.
    """
    row = F.struct(*cols)
    df = df.withColumn("_chunk", chunk)
    part = [*keys, "_chunk"]
    inner = Window.partitionBy(*part).orderBy(*order)
    lasts = df.groupBy(*part).agg(F.max_by(row, F.struct(*order)).alias("_last"))
    edges = lasts.select(*part, F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_edge"))
    return (
        df.withColumn("_local", F.lag(row).over(inner))
        .join(edges, part, "left")
        .withColumn(name, F.coalesce("_local", "_edge"))
        .drop("_chunk", "_local", "_edge")
    )


def position_in(df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[str], name: str = "pos") -> DataFrame:
    """1-based position within a key, numbered chunk by chunk.

    Same idea as ``previous_row``: rows are ranked inside (keys, chunk), and the
    sizes of the earlier chunks are added from a one-row-per-chunk table.
    """
    df = df.withColumn("_chunk", chunk)
    part = [*keys, "_chunk"]
    sizes = df.groupBy(*part).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    return (
        df.withColumn("_rn", local).join(offsets, part).withColumn(name, F.col("_off") + F.col("_rn")).drop("_chunk", "_rn", "_off")
    )
