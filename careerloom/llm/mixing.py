"""Mixing sources to target weights, in fixed-length blocks of words.

The words of a source, one document after the other, are cut into blocks of
``block`` words. The mix is a row of output shards with a fixed number of slots;
every shard draws how many of its slots each source gets (multinomial, seeded
by the shard's number). The slots of a source are numbered across shards, and
its draws are settled to the source's exact number of slots: slots beyond it
pass to sources that drew too few. Slot k of a source shows block P(k mod n) of
its n blocks, P being a keyed Feistel permutation, another one for every pass,
so a block comes again only after all others came. Blocks are then joined by
their index.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careerloom.llm.common import WORD, batches_of, rows_of
from careerloom.runtime import cut

_WORD = re.compile(WORD)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Shares of the total by weight; what exceeds ``most`` times a source's size is reshared by weight."""
    total, fixed = float(sum(sizes)), [False] * len(sizes)
    out = [0.0] * len(sizes)
    while True:
        left = total - sum(o for o, f in zip(out, fixed) if f)
        weight = sum(w for w, f in zip(weights, fixed) if not f)
        over = False
        for i, size in enumerate(sizes):
            if not fixed[i]:
                out[i] = left * weights[i] / weight if weight else 0.0
        for i, size in enumerate(sizes):
            if not fixed[i] and out[i] > most * size:
                out[i], fixed[i], over = most * size, True, True
        if not over:
            return out


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Keyed pseudorandom permutation of range(n), element by element: a Feistel network, walked until inside."""
    bits = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    x, todo = index.astype(np.uint64), np.arange(len(index))
    key = key.astype(np.uint64)
    while len(todo):
        b, m, v = bits[todo], mask[todo], x[todo]
        left, right = v >> b, v & m
        for r in range(rounds):
            f = (right + key[todo] + np.uint64(r * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f >> np.uint64(32)) & m)
        x[todo] = (left << b) | right
        todo = todo[x[todo] >= n[todo].astype(np.uint64)]
    return x.astype(np.int64)


@dataclass
class Plan:
    """``sized``: __row, doc_id, sid, size and first word; ``sources``: one row each; ``slots``: sid, blk, shard, slot, words."""

    sized: DataFrame
    sources: list[dict]
    slots: DataFrame
    block: int


def plan(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    most: float = 3.0,
    block: int = 64,
    shard_slots: int = 4096,
    bucket_rows: int = 1024,
    max_sources: int = 100_000,
    seed: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> Plan:
    """Decides what the mix takes. ``docs`` must have a column ``__row`` that is unique.

    A source gets as many whole passes as fit its target, and blocks of a further
    pass for the rest, the last of them cut to the words that are left. So a
    source smaller than a block meets its target to the word, a larger one to
    less than a block.

    One row per source comes to the driver, and more than ``max_sources``
    sources are an error; documents and slots never do.
    """
    sized = cut(
        rows_of(docs, "__row", id_col, text_col, source_col).select(
            "__row",
            F.col(f"`{id_col}`").alias("doc_id"),
            F.col(f"`{source_col}`").cast("string").alias("source"),
            word_count(F.col(f"`{text_col}`")).alias("size"),
            F.xxhash64(F.col(f"`{text_col}`")).alias("h"),
        )
    )
    named = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(max_sources + 1)
    found = sorted(named.collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    wanted = targets([r["size"] for r in found], [weights[i % len(weights)] for i in range(len(found))], most)
    sources = []
    for i, (r, t) in enumerate(zip(found, wanted)):
        words = round(t)
        passes = words // r["size"] if r["size"] else 0
        blocks, rest = -(-r["size"] // block), words - passes * r["size"]
        last = rest % block or block  # words of the last slot, if the rest needs any
        sources.append(
            {"sid": i, "source": r["source"], "size": r["size"], "target": t, "blocks": blocks,
             "slots": passes * blocks + -(-rest // block), "last": last if rest else block}
        )
    spark = docs.sparkSession
    ids = spark.createDataFrame(
        [(s["source"], s["sid"], s["size"], s["target"]) for s in sources], "source string, sid int, source_size long, target double"
    )
    # First word of each document within its source: sums inside small buckets, then over the buckets' sums.
    n = sum(r["n"] for r in found)
    buckets = max(1, n // bucket_rows)
    placed = sized.join(F.broadcast(ids), sized["source"].eqNullSafe(ids["source"])).select(
        "__row", "doc_id", "sid", "size", "h", "source_size", "target", F.pmod(F.xxhash64("doc_id", "h"), F.lit(buckets)).alias("bucket")
    )
    inside = Window.partitionBy("sid", "bucket").orderBy("doc_id", "h", "__row").rowsBetween(Window.unboundedPreceding, -1)
    starts = _sums_before(placed.groupBy("sid", "bucket").agg(F.sum("size").alias("words")), "bucket", "words", "start")
    placed = (
        placed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, ["sid", "bucket"])
        .withColumn("first", F.col("start") + F.col("within"))
        .drop("h", "bucket", "start", "within")
    )
    return Plan(placed, sources, _slots(spark, sources, block, shard_slots, seed), block)


def _sums_before(rows: DataFrame, order: str, value: str, name: str, chunk: int = 4096) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of their source that come before: within chunks, then over chunks."""
    rows = rows.withColumn("__chunk", F.floor(F.col(order) / chunk))
    along = Window.partitionBy("sid", "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy("sid", "__chunk").agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy("sid").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("sid", "__chunk", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    inside = rows.withColumn("__inside", F.coalesce(F.sum(value).over(along), F.lit(0)))
    joined = inside.join(chunks, ["sid", "__chunk"]).withColumn(name, (F.col("__before") + F.col("__inside")).cast("long"))
    return joined.drop("__chunk", "__before", "__inside")


def _slots(spark, sources: list[dict], block: int, shard_slots: int, seed: int) -> DataFrame:
    wanted = np.array([s["slots"] for s in sources], np.int64)
    blocks = np.array([s["blocks"] for s in sources], np.int64)
    total = int(wanted.sum())
    last = np.array([s["last"] for s in sources], np.int64)
    schema = "sid int, blk long, shard long, slot long, words long"
    if not total:
        return spark.createDataFrame([], schema)
    n_shards = -(-total // shard_slots)
    share = wanted / total

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = batch.column(0).to_numpy()
            counts = [
                np.random.default_rng([seed, s]).multinomial(min(shard_slots, total - s * shard_slots), share) for s in shards.tolist()
            ]
            if counts:
                counts = np.stack(counts)
                at, sid = np.nonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shards[at]), pa.array(sid.astype(np.int32)), pa.array(counts[at, sid])], names=["shard", "sid", "n"]
                )

    draws = cut(batches_of(spark.range(n_shards), draw, "shard long, sid int, n long"))
    got = np.zeros(len(sources), np.int64)
    for r in draws.groupBy("sid").agg(F.sum("n").alias("n")).collect():  # one row per source
        got[r["sid"]] = r["n"]
    extra, short = np.maximum(got - wanted, 0), np.maximum(wanted - got, 0)
    extra_from, short_to = np.cumsum(extra) - extra, np.cumsum(short)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, sid, n, first in zip(*(batch.column(c).to_pylist() for c in ("shard", "sid", "n", "first"))):
                k, source = first + np.arange(n), np.full(n, sid)
                over = k >= wanted[sid]
                m = extra_from[sid] + k[over] - wanted[sid]
                to = np.searchsorted(short_to, m, "right")
                source[over], k[over] = to, got[to] + m - (short_to[to] - short[to])
                size = blocks[source]
                key = (np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15 >> 8)) ^ (source.astype(np.uint64) << np.uint64(40)) ^ (k // size).astype(np.uint64)
                blk = permuted(k % size, size, key * np.uint64(0xD6E8FEB86659FD93))
                words = np.where(k == wanted[source] - 1, last[source], block)
                columns = source.astype(np.int32), blk, np.full(n, s), np.arange(n), words
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["sid", "blk", "shard", "slot", "words"])

    numbered = _sums_before(draws, "shard", "n", "first").select("shard", "sid", "n", "first")
    # The draws are small, the slots that come of them are not: every few shards are a task.
    return batches_of(numbered.repartition(min(n_shards, 10_000), "shard"), settle, schema)


def pieces(p: Plan) -> DataFrame:
    """``__row, at, n, uses``: runs of words of a document (from word ``at``) and how often the mix shows them."""
    whole = F.col("words") >= p.block
    uses = p.slots.groupBy("sid", "blk").agg(F.count_if(whole).alias("uses"), F.max(F.when(~whole, F.col("words"))).alias("part"))
    last = F.floor((F.col("first") + F.col("size") - 1) / p.block)
    of_docs = p.sized.filter("size > 0").select(
        "__row", "sid", "first", "size", F.explode(F.sequence(F.floor(F.col("first") / p.block), last)).alias("blk")
    )
    begin = F.col("blk") * p.block
    start = F.greatest(F.col("first"), begin)
    end = F.least(F.col("first") + F.col("size"), begin + p.block)
    # A slot that shows the first words of its block only parts the run in two.
    seam = F.least(end, F.greatest(start, begin + F.coalesce("part", F.lit(0))))
    run = lambda a, b, n: F.struct((a - F.col("first")).alias("at"), (b - a).alias("n"), n.alias("uses"))
    runs = F.array(run(start, seam, F.col("uses") + 1), run(seam, end, F.col("uses")))
    # A row per block of the corpus, which the optimiser takes for as few as the shards they are drawn in: never broadcast.
    found = of_docs.join(uses.hint("merge"), ["sid", "blk"]).select("__row", F.explode(runs).alias("r")).select("__row", "r.*")
    return found.filter("n > 0 and uses > 0")


def mix(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row.

    ``taken`` counts the words the mix takes of the document, repeats included.
    A null text or source: size 0, or the source that comes last. Documents
    without words are in no block. Without any words all targets are 0.
    Repeated rows are documents of their own.
    """
    p = plan(docs.withColumn("__row", F.monotonically_increasing_id()), **options)
    taken = pieces(p).groupBy("__row").agg(F.sum(F.col("n") * F.col("uses")).alias("taken"))
    return p.sized.join(taken, "__row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mix as documents: all columns of ``docs``, one row per pass over a document.

    The text of a row holds the words that its pass takes, with the white space
    between them as it was; words the mix leaves out are gone.
    """
    rows = cut(docs.withColumn("__row", F.monotonically_increasing_id()))
    p = plan(rows, text_col=text_col, **options)
    of_row = pieces(p).groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("at", "n", "uses"))).alias("__pieces"))
    joined = rows.join(of_row, "__row")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, texts, sizes = [], [], 0
            for i, (text, runs) in enumerate(zip(batch.column("text"), batch.column("pieces"))):
                text, runs = text.as_py(), runs.as_py()
                ends = [m.span() for m in _WORD.finditer(text)]
                for go in range(1, max(r["uses"] for r in runs) + 1):
                    out, now = [], None
                    for r in runs:
                        if r["uses"] >= go:
                            if now is not None and now[1] == r["at"]:
                                now[1] += r["n"]
                            else:
                                now = [r["at"], r["at"] + r["n"]]
                                out.append(now)
                    parts = [text[ends[a][0] : ends[b - 1][1]] for a, b in out]
                    whole = len(out) == 1 and out[0] == [0, len(ends)]
                    keep.append(i)
                    texts.append(text if whole else "\n".join(parts))
            rows_now = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("__row").take(rows_now), pa.array(texts, pa.string())], names=["__row", "__mixed"])

    taken = joined.select("__row", F.col(f"`{text_col}`").cast("string").alias("text"), F.col("__pieces").alias("pieces"))
    mixed = batches_of(taken, assemble, "__row long, __mixed string")
    others = rows.drop(text_col)
    return others.join(mixed, "__row").select(*(F.col("__mixed").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
