"""Exact top-k by integer inner product: tiles of queries and of vectors, selection per tile, merging in a tree.

Queries and vectors are packed into tiles of a fixed number of rows. A tile
pair is one matrix product; of it only each query's best ``k`` leave the task.
Lists of one query then meet in rounds of ``fan_in`` until one is left, so no
task ever holds more than ``fan_in`` lists of a query at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careerloom.llm.common import batches_of, rows_of

LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def usable(vector: Column) -> Column:
    """A vector without null or non-finite components, and not null itself."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def _tiles(rows: DataFrame, size: int) -> DataFrame:
    """``dim, grp, ids, values`` of up to ``size`` rows of one length and group: ids as 64-bit, components as doubles, row by row.

    ``rows`` (``dim, grp, vec_id, vector``) come sorted by length and group.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values, held, now = [], [], 0, None

        def out():
            nonlocal ids, values, held
            if held:
                i, v = np.concatenate(ids), np.concatenate(values)
                dim, grp = now
                for at in range(0, len(i), size):
                    cells = [i[at : at + size].tobytes()], [v[at * dim : (at + size) * dim].tobytes()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dim], pa.int32()), pa.array([grp], pa.int32()), *map(pa.array, cells)], names=["dim", "grp", "ids", "values"]
                    )
            ids, values, held = [], [], 0

        for batch in batches:
            dim, grp = batch.column("dim").to_numpy(), batch.column("grp").to_numpy()
            i = batch.column("vec_id").to_numpy().astype(np.int64)
            v = np.floor(batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            start = np.concatenate([[0], np.cumsum(dim)])
            cuts = np.flatnonzero(np.diff(grp) | np.diff(dim)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(grp)]):
                if s == e:
                    continue
                if (dim[s], grp[s]) != now or held >= size:
                    yield from out()
                now = (int(dim[s]), int(grp[s]))
                ids.append(i[s:e])
                values.append(v[start[s] : start[e]])
                held += e - s
        yield from out()

    return batches_of(rows, pack, "dim int, grp int, ids binary, values binary")


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All inner products of the rows of two tables of whole numbers, exact whatever their size."""
    most = np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * max(1, left.shape[1])
    if most < 2**53:
        return (left @ right.T).astype(np.int64)
    if most < 2**63:
        return left.astype(np.int64) @ right.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    return whole(left).dot(whole(right).T)


def _sortable(x: int) -> str | None:
    """Text that sorts like whole numbers of any length; null for those that are longs."""
    if LOW <= x <= HIGH:
        return None
    digits = str(abs(x))
    if x > 0:
        return f"1{len(digits):06d}{digits}"
    return f"0{999_999 - len(digits):06d}{''.join(str(9 - int(d)) for d in digits)}"


def _best(scores: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Which candidates are among the first ``k`` of each row: highest scores, ties to the earlier column, ``own`` ones never."""
    real = ~own
    if k >= scores.shape[1]:
        return real
    if scores.dtype == object:
        out = np.zeros(scores.shape, bool)
        for i, row in enumerate(scores):
            first = sorted(np.flatnonzero(real[i]), key=lambda j: -row[j])[:k]
            out[i, first] = True
        return out
    ranked = np.where(own, LOW, scores)
    least = np.partition(ranked, ranked.shape[1] - k, axis=1)[:, -k][:, None]
    above, level = ranked > least, ranked == least
    return (above | (level & (level.cumsum(1) <= k - above.sum(1, keepdims=True)))) & real


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 1024,
    query_tile: int = 4096,
    tile: int = 2048,
    fan_in: int = 16,
    tiles_per_task: int = 16,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's ``k`` highest scores, ties to the smaller id.

    A component x counts as floor(``scale`` * x); products are exact, in doubles
    where these suffice, in 64-bit or longer integers elsewhere. A score beyond
    64 bits is shown as the largest or smallest long, and ranks by what it is. A
    query is never its own candidate (rows with its id). Vectors that are null
    or hold null or non-finite components take no part, nor do rows with a null
    id; vectors meet those of their own length. Repeated rows are candidates as
    often as they occur. With fewer than ``k`` candidates all are returned; an
    empty table gives an empty result.
    """

    def ready(rows: DataFrame) -> DataFrame:
        # Whole numbers, as doubles: Spark's floor() would end at 64 bits.
        scaled = F.transform(F.col(f"`{vector_col}`").cast("array<double>"), lambda v: v * scale)
        return (
            rows_of(rows, id_col, vector_col)
            .filter(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
            .select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("vector"))
        )

    found, asked = ready(vectors), ready(queries)
    dim = F.size("vector").alias("dim")
    n_queries = asked.count()
    n_vectors = found.count()
    groups, n_tiles = max(1, -(-n_queries // query_tile)), max(1, -(-n_vectors // tile))
    # Every query tile meets every tile of vectors: the stated query set, in blocks. The tiles of vectors are dealt out
    # by a salt, and every salt gets its copy of the query tiles.
    salts = -(-n_tiles // tiles_per_task)
    by_group = asked.select("vec_id", "vector", dim, F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("grp"))
    by_group = by_group.repartition(groups, "grp").sortWithinPartitions("dim", "grp")
    query_tiles = _tiles(by_group, 2 * query_tile).select(
        "dim", "grp", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.col("ids").alias("q_ids"), F.col("values").alias("q_values")
    )
    packed = _tiles(found.select("vec_id", "vector", dim, F.lit(0).alias("grp")).sortWithinPartitions("dim"), tile)
    tiles = packed.select(
        "dim", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int").alias("salt"), "ids", "values"
    )

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, q_ids, q_values, ids, values in zip(*(batch.column(c) for c in ("dim", "q_ids", "q_values", "ids", "values"))):
                dim = dim.as_py()
                q, v = (np.frombuffer(x.as_py(), np.int64) for x in (q_ids, ids))
                order = np.argsort(v, kind="stable")
                left, right = (np.frombuffer(x.as_py()).reshape(len(n), dim) for x, n in ((q_values, q), (values, v)))
                v, right = v[order], right[order]
                for s in range(0, len(q), 1024):
                    scores = _products(left[s : s + 1024], right)
                    i, j = np.nonzero(_best(scores, q[s : s + 1024, None] == v[None, :], k))
                    shown = np.array(np.clip(scores[i, j], LOW, HIGH), np.int64)
                    beyond = [_sortable(x) for x in scores[i, j].tolist()] if scores.dtype == object else [None] * len(i)
                    columns = [pa.array(q[s + i]), pa.array(v[j]), pa.array(shown), pa.array(beyond, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score", "exact"])

    best = batches_of(
        tiles.join(query_tiles, ["dim", "grp", "salt"]).select("dim", "q_ids", "q_values", "ids", "values"),
        products,
        "query_id long, vec_id long, score long, exact string",
    )
    # Tree: lists of a query are dealt to groups, each group keeps k, until one group is left.
    width = -(-n_tiles // fan_in)
    while width > 1:
        deal = F.pmod(F.xxhash64("vec_id"), F.lit(width)).cast("int")
        w = Window.partitionBy("query_id", deal).orderBy(F.desc("score"), F.desc_nulls_last("exact"), "vec_id")
        best = best.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")
        width = width // fan_in
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("exact"), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
