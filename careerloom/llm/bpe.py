"""Byte-level BPE: overlapping chunks are pre-tokenised in parallel, stitched, then encoded piece by piece.

A text longer than a chunk becomes chunk rows that reach ``overlap`` characters
into the next one. Each is pre-tokenised from its own raw start, possibly out of
step with the true boundaries. At the seam, the first boundary that both sides
have is where they resynchronise: what follows a boundary depends only on the
text after it, so from there on both agree, and the left chunk ends and the
right one begins at that point. A seam without a common boundary (one piece
longer than the overlap) sends its whole document through one unbroken pass.
Texts of one chunk have no seam and take the same encoder without a shuffle.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from careerloom.llm.common import batches_of, rows_of


#: Bytes of encoded rows that a task hands on at once: they lie in the worker twice and in the executor outside of its heap.
OUT_BYTES = 2 << 20


class PieceCache(dict):
    """Piece of text -> its ids as little-endian bytes; bounded by starting over."""

    def __init__(self, encode, most: int = 50_000):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = np.array(self.encode(piece), "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Codec:
    """Merge ranks and the pre-token pattern, ready for use in a task."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        # The library's merge loop, one piece at a time: under this pattern a piece stays whole.
        self.merges = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.cache = PieceCache(self.merges.encode_ordinary)
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            self.bytes_of[rank] = piece

    def encode(self, text: str) -> bytes:
        """Ids of a text that starts and ends at true boundaries, as little-endian 32-bit integers."""
        return b"".join(map(self.cache.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def boundaries(self, text: str) -> np.ndarray:
        """Starts of all pieces."""
        return np.fromiter((m.start() for m in self.pattern.finditer(text)), np.int32)


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _flushed(names: list[str], types: list[pa.DataType], most_bytes: int = OUT_BYTES):
    """Collects rows and hands them on as batches of bounded bytes."""
    rows: list[tuple] = []
    held = 0

    def add(row: tuple | None, weight: int = 0) -> Iterator[pa.RecordBatch]:
        nonlocal rows, held
        if row is not None:
            rows.append(row)
            held += weight
        if rows and (row is None or held >= most_bytes or len(rows) >= 10_000):
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            rows, held = [], 0
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return add


def encode(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = 32768,
    overlap: int = 1024,
) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every row, repeated rows included.

    ``ids`` are little-endian unsigned 32-bit integers, ``decoded`` the bytes
    they stand for. A null or empty text has no ids. Texts of any length are
    encoded whole, each match of ``pattern`` on its own, without special tokens.
    """
    if not 0 < overlap <= chunk:
        raise ValueError("the overlap must be positive and no longer than a chunk")
    rows = rows_of(docs, id_col, text_col).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    id_type = rows.schema["doc_id"].dataType.simpleString()
    is_long = F.length("text") > chunk

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = codec(path, pattern)
        for batch in batches:
            # One text at a time is turned into Python objects.
            ids_of, texts = batch.column(0), batch.column(1)
            out: list[tuple] = []
            held, start = 0, 0
            for i in range(batch.num_rows):
                ids = tools.encode(texts[i].as_py() or "")
                decoded = tools.decode(ids)
                out.append((len(ids) // 4, ids, decoded))
                held += len(ids) + len(decoded)
                if held >= OUT_BYTES or i + 1 == batch.num_rows:
                    n, a, b = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [ids_of.slice(start, len(out)), pa.array(n, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary())],
                        names=["doc_id", "n_tokens", "ids", "decoded"],
                    )
                    out, held, start = [], 0, i + 1

    schema = f"doc_id {id_type}, n_tokens long, ids binary, decoded binary"
    short = batches_of(rows.filter(~F.coalesce(is_long, F.lit(False))), whole, schema)
    long = rows.filter(is_long).withColumn("row", F.monotonically_increasing_id())
    return short.union(_encode_long(long, path, pattern, chunk, overlap))


def _encode_long(long: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add = _flushed(["row", "chunk", "last", "text"], [pa.int64(), pa.int32(), pa.bool_(), pa.string()])
        for batch in batches:
            for row, text in zip(batch.column(0), batch.column(1)):
                row, text = row.as_py(), text.as_py()
                n = -(-len(text) // chunk)
                for k in range(n):
                    yield from add((row, k, k + 1 == n, text[k * chunk : (k + 1) * chunk + overlap]), 2 * chunk)
        yield from add(None)

    def pretokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Boundaries at both ends of a chunk: all that a seam needs."""
        tools = codec(path, pattern)
        for batch in batches:
            heads, tails = [], []
            for last, text in zip(batch.column("last"), batch.column("text")):
                starts = tools.boundaries(text.as_py())
                heads.append(starts[starts < overlap])
                tails.append(starts[:0] if last.as_py() else starts[starts >= chunk] - chunk)
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("chunk"), pa.array(heads, lists), pa.array(tails, lists)],
                names=["row", "chunk", "head", "tail"],
            )

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = codec(path, pattern)
        add = _flushed(["row", "chunk", "ids", "decoded"], [pa.int64(), pa.int32(), pa.binary(), pa.binary()])
        for batch in batches:
            for row, k, text, start, end in zip(*(batch.column(c) for c in ("row", "chunk", "text", "start", "end"))):
                end = end.as_py()
                ids = tools.encode(text.as_py()[start.as_py() : end])
                yield from add((row.as_py(), k.as_py(), ids, tools.decode(ids)), 3 * len(ids))
        yield from add(None)

    # Chunks of one document land in different tasks.
    chunks = batches_of(long.select("row", "text"), cut_up, "row long, chunk int, last boolean, text string")
    chunks = chunks.repartition("row", "chunk")
    ends = batches_of(chunks, pretokenised, "row long, chunk int, head array<int>, tail array<int>")
    along = Window.partitionBy("row").orderBy("chunk")
    meets = F.array_min(F.array_intersect("tail", F.lead("head").over(along)))
    seams = (
        ends.select("row", "chunk", meets.alias("meets"), F.lead("chunk").over(along).isNull().alias("is_last"))
        .withColumn("start", F.coalesce(F.lag("meets").over(along), F.lit(0)))
        .withColumn("broken", F.max(F.col("meets").isNull() & ~F.col("is_last")).over(Window.partitionBy("row")))
    )
    sound = seams.filter("not broken").select(
        "row", "chunk", "start", F.when(~F.col("is_last"), F.col("meets") + chunk).alias("end")
    )
    parts = batches_of(
        chunks.join(sound, ["row", "chunk"]).select("row", "chunk", "text", "start", "end"),
        encoded,
        "row long, chunk int, ids binary, decoded binary",
    )
    broken = seams.filter("broken").select("row").distinct()
    unbroken = long.join(broken, "row", "left_semi").select(
        "row", F.lit(0).alias("chunk"), "text", F.lit(0).alias("start"), F.lit(None).cast("int").alias("end")
    )
    parts = parts.union(batches_of(unbroken, encoded, "row long, chunk int, ids binary, decoded binary"))

    def joined(column: str):
        return F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p[column])), ""))

    whole = (
        parts.groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("chunk", "ids", "decoded"))).alias("parts"))
        .select("row", joined("ids").alias("ids"), joined("decoded").alias("decoded"))
    )
    return (
        long.select("row", "doc_id")
        .join(whole, "row")
        .select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")
    )
