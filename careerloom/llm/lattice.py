"""Embedding near-duplicates by lattice hashing: random projections decoded to E8 points, cosine verified.

Every table projects a unit vector to two eight-dimensional blocks and decodes
each to the nearest point of the E8 lattice; the two points name the vector's
cell. A vector also probes the cells whose point in one block is the next
nearest. All members of a cell, at home or probing, are compared with the
vectors at home there. A cell with many members is cut into pieces of bounded
size, and every pair of pieces is one unit of work; only counts per vector and
a spanning forest of its links leave a unit, never its pairs. A pair that
several tables or probes bring together is counted by the first of them alone.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careerloom.llm.common import batches_of, rows_of
from careerloom.llm.components import components
from careerloom.llm.topk import usable
from careerloom.runtime import cut

BLOCKS = 2


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    r = np.rint(x)
    d = x - r
    odd = np.flatnonzero(r.sum(1) % 2)
    k = np.abs(d[odd]).argmax(1)
    r[odd, k] += np.where(d[odd, k] >= 0, 1.0, -1.0)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: the even integer points and their shift by one half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


@lru_cache(1)
def shortest_e8() -> np.ndarray:
    """The 240 shortest vectors: steps to the neighbouring cells."""
    steps = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            steps.append(v)
    halves = (np.array(s) for s in itertools.product((0.5, -0.5), repeat=8))
    return np.array(steps + [v for v in halves if (v < 0).sum() % 2 == 0])


class Tables:
    """Cells of unit vectors in all tables. ``width`` is the lattice's unit for vectors of 64 components."""

    def __init__(self, tables: int = 4, probes: int = 4, width: float = 0.3, seed: int = 8):
        self.tables, self.probes, self.width, self.seed = tables, probes, width, seed
        self.projections: dict[int, list[np.ndarray]] = {}

    def _projection(self, dim: int) -> list[np.ndarray]:
        if dim not in self.projections:
            rng = np.random.default_rng([self.seed, dim])
            made = []
            for _ in range(self.tables):
                g = rng.normal(size=(dim, max(dim, 8 * BLOCKS)))
                # Orthonormal where there is room; then scaled to what 64 components would give.
                p = np.linalg.qr(g)[0][:, : 8 * BLOCKS] * np.sqrt(dim) if dim >= 8 * BLOCKS else g
                made.append(p[:, : 8 * BLOCKS] / 8 / self.width)
            self.projections[dim] = made
        return self.projections[dim]

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """``[vector, table, 1 + probes]`` 64-bit cell keys, the vector's own cell first."""
        n, dim = unit.shape
        out = np.empty((n, self.tables, 1 + self.probes), np.int64)
        steps = shortest_e8()
        rng = np.random.default_rng(self.seed)
        mix = rng.integers(1, 2**63, size=(8 * BLOCKS,), dtype=np.int64).astype(np.uint64) | np.uint64(1)
        for t, projection in enumerate(self._projection(dim)):
            y = unit @ projection
            keys, costs = [], []
            own = np.full(n, (t * 0x9E3779B97F4A7C15 + dim) & (2**64 - 1), np.uint64)
            for b in range(BLOCKS):
                at = slice(8 * b, 8 * b + 8)
                point = nearest_e8(y[:, at])
                own += ((2 * point).astype(np.int64).astype(np.uint64) * mix[at]).sum(1, dtype=np.uint64)
                if self.probes:
                    gain = (y[:, at] - point) @ steps.T
                    best = np.argpartition(-gain, self.probes, axis=1)[:, : self.probes]
                    costs.append(-np.take_along_axis(gain, best, 1))
                    keys.append(((2 * steps[best]).astype(np.int64).astype(np.uint64) * mix[at]).sum(2, dtype=np.uint64))
            out[:, t, 0] = own.view(np.int64)
            if self.probes:
                order = np.argsort(np.concatenate(costs, 1), axis=1, kind="stable")[:, : self.probes]
                moved = own[:, None] + np.take_along_axis(np.concatenate(keys, 1), order, 1)
                out[:, t, 1:] = moved.view(np.int64)
        return out


def _unit(values: np.ndarray) -> np.ndarray:
    return values / np.sqrt((values * values).sum(1))[:, None]


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row positions and their vectors as doubles, vectors of one length at a time."""
    column = batch.column("vector")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    first = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield at, flat[first[at][:, None] + np.arange(dim)]


def _meetings(owners: tuple, members: tuple, least: float) -> tuple | None:
    """Members and owners of one unit that have a link, with the matrix of links; None without any.

    Both sides are (id, copies, unit vectors).
    """
    (o_id, o_n, o_v), (m_id, m_n, m_v) = owners, members
    hits = (m_v @ o_v.T >= least) & (m_id[:, None] != o_id[None, :])
    i, j = np.flatnonzero(hits.any(1)), np.flatnonzero(hits.any(0))
    if not len(i):
        return None
    return m_id[i], m_n[i], m_v[i], o_id[j], o_n[j], o_v[j], hits[np.ix_(i, j)]


def near_duplicates(
    vectors: DataFrame,
    least: float = 0.95,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tables: int = 4,
    probes: int = 4,
    width: float = 0.3,
    piece: int = 1024,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Rows with equal vectors form one class and are linked with each other.
    Vectors of different lengths, and vectors that are null, empty, zero or
    hold null or non-finite components, link with nothing: no links, their own
    component, kept. So do rows with a null id, whose component is null.
    Repeated rows count as vectors of their own.
    """
    hashing = Tables(tables, probes, width)
    rows = rows_of(vectors, id_col, vector_col).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")
    )
    fits = F.col("vec_id").isNotNull() & usable(F.col("vector")) & F.exists("vector", lambda v: v != 0)
    rows = rows.withColumn("vector", F.when(F.coalesce(fits, F.lit(False)), F.col("vector")))
    classes = rows.filter("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()))

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("cid").to_numpy()
            for at, values in _by_length(batch):
                keys = hashing.cells(_unit(values))
                n = keys.shape[1] * keys.shape[2]
                home = np.zeros(keys.shape, bool)
                home[:, :, 0] = True
                table = np.broadcast_to(np.arange(keys.shape[1], dtype=np.int8)[None, :, None], keys.shape)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.ravel()) for x in (np.repeat(ids[at], n), table, keys, home)], names=["cid", "tab", "cell", "home"]
                )

    placed = batches_of(classes.select("cid", "vector"), cells_of, "cid long, tab byte, cell long, home boolean")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("members"), F.count_if("home").alias("owners"))
    # Cells where somebody is at home and somebody else may be met; how many pieces their rows need.
    sizes = cut(
        sizes.filter("owners > 0 and members > 1").select(
            "cell", F.ceil(F.col("owners") / piece).alias("o_parts"), F.ceil(F.col("members") / piece).alias("m_parts")
        )
    )
    spot = placed.join(sizes, "cell")
    own_part = F.pmod(F.xxhash64("cid"), F.col("o_parts"))
    member_part = F.pmod(F.xxhash64("cid"), F.col("m_parts"))
    as_member = spot.select(
        "cid", "tab", "cell", F.lit(1).alias("role"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("o_parts") - 1)).alias("o"), member_part.alias("m")
    )
    as_owner = spot.filter("home").select(
        "cid", "tab", "cell", F.lit(0).alias("role"), own_part.alias("o"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("m_parts") - 1)).alias("m")
    )
    units = as_owner.union(as_member).join(classes.select("cid", "copies", "vector"), "cid")
    units = units.repartition("cell", "o", "m").sortWithinPartitions("cell", "o", "m", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides, table = None, ([], []), 0

        def joined(parts):
            by_length: dict[int, list] = {}
            for part in parts:
                by_length.setdefault(part[2].shape[1], []).append(part)
            return {d: tuple(np.concatenate(x) for x in zip(*p)) for d, p in by_length.items()}

        def done():
            owners, members = joined(sides[0]), joined(sides[1])
            for dim in owners.keys() & members.keys():
                met = _meetings(owners[dim], members[dim], least)
                if met is not None:
                    yield from _summed(met, hashing, table)

        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("cell", "o", "m")])
            role, tab = batch.column("role").to_numpy(), batch.column("tab").to_numpy()
            ids, copies = batch.column("cid").to_numpy(), batch.column("copies").to_numpy()
            lengths = list(_by_length(batch))
            unit_of = np.empty(len(ids), object)
            for at, values in lengths:
                units_at = _unit(values)
                for i, v in zip(at, units_at):
                    unit_of[i] = v
            cuts = np.flatnonzero((np.diff(key) != 0).any(0) | (np.diff(role) != 0)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(ids)]):
                if s == e:
                    continue
                name = tuple(key[:, s])
                if name != now:
                    if sides[0] and sides[1]:
                        yield from done()
                    now, sides, table = name, ([], []), int(tab[s])
                span = unit_of[s:e]
                dims = np.array([len(v) for v in span])
                for d in np.unique(dims):
                    at = np.flatnonzero(dims == d)
                    sides[role[s]].append((ids[s:e][at], copies[s:e][at], np.stack(span[at])))
        if sides[0] and sides[1]:
            yield from done()

    found = cut(batches_of(units.select("cid", "tab", "cell", "o", "m", "role", "copies", "vector"), compare, "cid long, links long, root long"))
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    parts = components(found.select("cid", "root"), "cid", "root")
    smallest = classes.join(parts, classes["cid"] == parts["node"]).groupBy("component").agg(F.min("rep").alias("smallest"))
    of_class = (
        classes.join(counts, "cid", "left")
        .join(parts.join(smallest, "component"), classes["cid"] == F.col("node"), "left")
        .select(
            "vector",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("smallest", "rep").alias("component_id"),
        )
    )
    return rows.join(of_class, "vector", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"),
    )


def _summed(met, hashing: Tables, table: int, step: int = 64) -> Iterator[pa.RecordBatch]:
    """Links per vector that this unit is the first to see, and each vector's root in the unit's links."""
    m_id, m_n, m_v, o_id, o_n, o_v, hits = met
    m_cells, o_cells = hashing.cells(m_v), hashing.cells(o_v)
    m_links, o_links = np.zeros(len(m_id), np.int64), np.zeros(len(o_id), np.int64)

    def at_home(members: np.ndarray, owners: np.ndarray, t: int) -> np.ndarray:
        """Does the member visit the owner's own cell in table t?"""
        return (members[:, t, :] == owners[:, t, :1]).any(1)

    for start in range(0, len(m_id), step):
        i, j = np.nonzero(hits[start : start + step])
        i += start
        m, o = m_cells[i], o_cells[j]
        first = np.ones(len(i), bool)
        for t in range(table):
            first &= ~(at_home(m, o, t) | at_home(o, m, t))
        # In one table the pair may meet in both vectors' cells: the smaller owner's counts.
        first &= (o_id[j] < m_id[i]) | ~at_home(o, m, table)
        i, j = i[first], j[first]
        np.add.at(m_links, i, o_n[j])
        np.add.at(o_links, j, m_n[i])
    root_m, root_o = m_id.copy(), o_id.copy()
    far = np.iinfo(np.int64).max
    while True:
        new_m = np.minimum(root_m, np.where(hits, root_o[None, :], far).min(1))
        new_o = np.minimum(root_o, np.where(hits, new_m[:, None], far).min(0))
        if (new_m == root_m).all() and (new_o == root_o).all():
            break
        root_m, root_o = new_m, new_o
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(x)) for x in ((m_id, o_id), (m_links, o_links), (root_m, root_o))], names=["cid", "links", "root"]
    )
