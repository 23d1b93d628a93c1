"""SimHash near-duplicates over a Gray-order hierarchical index.

Distinct fingerprints are sorted by Gray rank, where neighbours share most
bits, and cut into parts. In a part, runs of fingerprints form leaves and runs
of nodes form upper nodes; a node keeps the bits that all below it share and
that its parent does not already fix. A search adds up the differences along
the way down and drops a whole node once they exceed the bound. The same tree,
built over the parts' own top nodes, says which parts a fingerprint must visit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerloom.llm.common import WORD, batches_of, rows_of, words_of
from careerloom.llm.components import components
from careerloom.llm.passages import _alike, _roots
from careerloom.runtime import cut

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint_of(text: bytes | None, shingle: int = 3, seed: int = 42, step: int = 65536) -> int:
    """64-bit SimHash of the word shingles, repeats included; 0 without words.

    A bit is 1 if it is set in over half of the shingles' XXH64. Long texts are
    hashed ``step`` shingles at a time.
    """
    words = words_of(text)
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for start in range(0, n, step):
        part = words[start : start + min(step, n - start) + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64)
        bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64)
        for at in range(0, len(bits), 128):  # sums of at most 128 fit a byte
            counts += np.add.reduce(bits[at : at + 128], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a long) of every row. Null and blank texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint_of(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    rows = rows_of(docs, id_col, text_col).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")
    )
    return batches_of(rows, run, "doc_id long, fp long")


def gray_rank(fp: Column) -> Column:
    """Position of a 64-bit code in reflected Gray order, as a signed long that sorts the same way."""
    r = fp
    for k in (1, 2, 4, 8, 16, 32):
        r = r.bitwiseXOR(F.shiftrightunsigned(r, k))
    return r.bitwiseXOR(F.lit(-(1 << 63)))


def _rotated(fp: Column, tables: int) -> Column:
    """The fingerprint with segment ``tab`` of ``tables`` put first."""
    out = fp
    for t in range(1, tables):
        k = 64 // tables * t
        out = F.when(F.col("tab") == t, F.shiftleft(fp, k).bitwiseOR(F.shiftrightunsigned(fp, 64 - k))).otherwise(out)
    return out


class GrayTree:
    """Hierarchy over codes in Gray order; ``search`` finds all codes within ``reach`` bits."""

    def __init__(self, codes: np.ndarray, masks: np.ndarray | None = None, width: int = 8):
        # A code may itself stand for a group: then only the bits of its mask are fixed.
        mask = np.full(len(codes), FULL) if masks is None else masks
        self.levels = [(codes & mask, mask)]
        while len(self.levels[0][0]) > width:
            code, mask = self.levels[0]
            at = np.arange(0, len(code), width)
            shared = np.bitwise_and.reduceat(mask, at)
            ones, any_one = np.bitwise_and.reduceat(code, at), np.bitwise_or.reduceat(code, at)
            shared &= ~(ones ^ any_one)
            self.levels.insert(0, (ones & shared, shared))
        self.width = width

    def search(
        self, queries: np.ndarray, reach: int, head: int = 64, head_reach: int = 64, step: int = 512
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (position of the query, position of the code), by query.

        At most ``head_reach`` of the differences may lie in the first ``head`` bits.
        """
        head_mask = ~(FULL >> np.uint64(head)) if head < 64 else FULL
        for start in range(0, len(queries), step):
            q = queries[start : start + step]
            qi, node = (x.ravel() for x in np.indices((len(q), len(self.levels[0][0]))))
            spent, spent_head = np.zeros(len(qi), np.uint8), np.zeros(len(qi), np.uint8)
            above = np.zeros(len(qi), np.uint64)
            for depth, (code, mask) in enumerate(self.levels):
                if depth:  # to the children
                    size = np.minimum(self.width, len(code) - node * self.width)
                    first = np.repeat(node * self.width, size)
                    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    qi, spent, spent_head, above = (np.repeat(x, size) for x in (qi, spent, spent_head, above))
                    node = first + inner
                new = (q[qi] ^ code[node]) & mask[node] & ~above
                spent, spent_head = spent + np.bitwise_count(new), spent_head + np.bitwise_count(new & head_mask)
                keep = (spent <= reach) & (spent_head <= head_reach)
                qi, node, spent, spent_head = qi[keep], node[keep], spent[keep], spent_head[keep]
                above = mask[node]
            yield qi + start, node


class _Forest:
    """Labels of a part's fingerprints; new links leave it only as far as they join what was apart."""

    def __init__(self, ids: np.ndarray):
        self.label = ids.copy()

    def joined(self, q_ids: np.ndarray, qi: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges that connect all that the links (qi, at), sorted by qi, connect."""
        first = np.flatnonzero(np.diff(qi, prepend=-1))
        mine = q_ids[qi[first]].copy()
        group = np.repeat(np.arange(len(first)), np.diff([*first, len(qi)]))
        codes, where = np.unique(at, return_inverse=True)
        before, now = self.label[codes], self.label[codes].copy()
        while True:
            least = np.minimum(mine, np.minimum.reduceat(now[where], first))
            new = now.copy()
            np.minimum.at(new, where, least[group])
            if (new == now).all() and (least == mine).all():
                break
            mine, now = least, new
        self.label[codes] = now
        # Chains of labels end where the rounds ended; every old label is tied to the new one.
        edges = np.unique(np.column_stack([np.concatenate([before, q_ids[qi[first]]]), np.concatenate([now, mine])]), axis=0)
        edges = edges[edges[:, 0] != edges[:, 1]]
        return edges[:, 0], edges[:, 1]


def links(
    classes: DataFrame,
    reach: int = 2,
    tables: int = 1,
    least_match: float | None = None,
    part_rows: int = 65536,
    least_parts: int = 16,
    most_parts: int = 65536,
) -> DataFrame:
    """Pairs ``a, b`` of ids that connect all fingerprints that differ in at most ``reach`` bits.

    ``classes`` has one row per fingerprint: ``fp`` and ``rep``, and with
    ``least_match`` a ``sketch``, in which that share of bits must agree too. There
    are at least ``least_parts`` parts, and a part holds at most ``part_rows``
    fingerprints, more only beyond ``most_parts`` parts. Few parts matter: a
    fingerprint visits all parts that may hold a partner. The parts' top nodes, 20 bytes each and at most ``most_parts``, are
    the only thing that is broadcast. The search is exact, without a cap on
    partners. A wide reach needs several ``tables``: in each the fingerprint is
    rotated, and one of its equal segments, put first, holds at most its share
    of the differences in any pair (pigeonhole), which prunes the tree early.
    Links within a part leave it as a spanning forest.
    """
    spark = classes.sparkSession
    head, head_reach = (64, reach) if tables == 1 else (64 // tables, reach // tables)
    sketch = F.col("sketch") if least_match is not None else F.lit(b"")
    n_parts = min(most_parts, max(least_parts, -(-classes.count() // part_rows)))
    turns = F.explode(F.array(*(F.lit(t) for t in range(tables)))).alias("tab")
    turned = classes.select("fp", "rep", sketch.alias("sketch"), turns).select("rep", "sketch", "tab", _rotated(F.col("fp"), tables).alias("fp"))
    ranked = turned.withColumn("rank", gray_rank(F.col("fp"))).repartitionByRange(n_parts * tables, "tab", "rank")
    ranked = cut(ranked.withColumn("part", F.spark_partition_id() * tables + F.col("tab")).drop("rank"))
    tops = (
        ranked.groupBy("part")
        .agg(F.bit_and("fp").alias("ones"), F.bit_or("fp").alias("any_one"), F.min(gray_rank(F.col("fp"))).alias("first"))
        .orderBy("first")
        .collect()
    )
    by_table = []
    for t in range(tables):
        mine = [r for r in tops if r["part"] % tables == t]
        ones, any_one = (np.array([r[c] for r in mine], np.int64).view(np.uint64) for c in ("ones", "any_one"))
        by_table.append((np.array([r["part"] for r in mine], np.int32), ones, ~(ones ^ any_one)))
    shared = spark.sparkContext.broadcast(by_table)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = []
        for ids, codes, masks in shared.value:
            order = np.empty(int(ids.max(initial=-1)) + 1, np.int64)
            order[ids] = np.arange(len(ids))
            trees.append((ids, order, GrayTree(codes, masks) if len(ids) else None))
        for batch in batches:
            part = batch.column("part").to_numpy()
            for t, (ids, order, tree) in enumerate(trees):
                mine = np.flatnonzero(part % tables == t)
                if not len(mine):
                    continue
                fp, own = batch.column("fp").to_numpy()[mine].view(np.uint64), order[part[mine]]
                for qi, to in tree.search(fp, reach, head, head_reach):
                    later = to > own[qi]  # a pair is met once, in the later part
                    qi, to = mine[qi[later]], to[later]
                    rows = pa.array(qi)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[to]), pa.array(np.ones(len(to), np.int8)), *(batch.column(c).take(rows) for c in ("fp", "rep", "sketch"))],
                        names=["part", "visits", "fp", "rep", "sketch"],
                    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, owned, ids, sketches, tree, forest = None, [], None, None, None, None

        def found(q_fp, q_ids, q_sketches, inside):
            for qis, ats in tree.search(q_fp, reach, head, head_reach):
                # In a dense group nearly all pairs are close: they are looked at in pieces of bounded size.
                for start in range(0, len(qis), 1 << 18):
                    qi, at = qis[start : start + (1 << 18)], ats[start : start + (1 << 18)]
                    keep = ids[at] > q_ids[qi] if inside else ids[at] != q_ids[qi]
                    if least_match is not None:
                        alike = 1 - np.bitwise_count(q_sketches[qi] ^ sketches[at]).sum(1, dtype=np.int64) / (64 * sketches.shape[1])
                        keep &= alike >= least_match
                    if keep.any():
                        # The frontier keeps the queries' order, so equal ones stand together.
                        a, b = forest.joined(q_ids, qi[keep], at[keep])
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        def grown():
            nonlocal tree, forest, ids, sketches, owned
            if owned:
                fps, ids, sketches = (np.concatenate(x) for x in zip(*owned))
                rank = fps.copy()
                for k in (1, 2, 4, 8, 16, 32):
                    rank ^= rank >> np.uint64(k)
                order = np.argsort(rank, kind="stable")
                fps, ids, sketches, owned = fps[order], ids[order], sketches[order], []
                tree, forest = GrayTree(fps), _Forest(ids)
                yield from found(fps, ids, sketches, True)

        for batch in batches:
            part, visits = batch.column("part").to_numpy(), batch.column("visits").to_numpy()
            fp, rep = batch.column("fp").to_numpy().view(np.uint64), batch.column("rep").to_numpy()
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(len(fp), -1)
            cuts = np.flatnonzero(np.diff(part) | np.diff(visits)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(part)]):
                if s == e:
                    continue
                if part[s] != now:
                    yield from grown()
                    now, tree = part[s], None
                if not visits[s]:
                    owned.append((fp[s:e].copy(), rep[s:e].copy(), sketch[s:e].copy()))
                else:
                    yield from grown()
                    yield from found(fp[s:e], rep[s:e], sketch[s:e], False)
        yield from grown()

    columns = ("part", "fp", "rep", "sketch")
    visits = batches_of(ranked.select(*columns), route, "part int, visits byte, fp long, rep long, sketch binary")
    owners = ranked.select("part", F.lit(0).cast("byte").alias("visits"), "fp", "rep", "sketch")
    together = owners.union(visits).repartition("part").sortWithinPartitions("part", "visits")
    return batches_of(together, search, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, reach: int = 2
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Texts with equal fingerprints form one class, whose smallest id stands for
    it; classes within ``reach`` bits are linked, and components are closed
    over links. Null and blank texts have fingerprint 0 and are linked like any
    other. A row with a null id gets its fingerprint and a null component, and
    links nothing. Repeated rows come back as often as they came.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    classes = cut(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    parts = components(links(classes, reach))
    of_class = classes.join(parts, classes["rep"] == parts["node"], "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return prints.join(of_class, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def shingles_of(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """Distinct hashes of a text's word shingles, sorted; a shorter text is one shingle."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(5)), np.uint64, n))


def _smallest(h: np.ndarray, bins: int = 256) -> np.ndarray:
    """The smallest shingle hash of each bin; empty bins borrow from others."""
    at = (h >> np.uint64(56)).astype(np.int64) * bins // 256
    filled, first = np.unique(at, return_index=True)
    value = np.zeros(bins, np.uint64)
    full = np.zeros(bins, bool)
    value[filled], full[filled] = h[first], True
    empty, step = np.flatnonzero(~full), 0
    while len(empty) and len(filled):
        step += 1
        lender = ((empty * 0x9E3779B1 + step * 0x85EBCA6B) % 0x7FFFFFFF) % bins
        ok = full[lender]
        value[empty[ok]] = value[lender[ok]] + (empty[ok].astype(np.uint64) << np.uint64(1))
        empty = empty[~ok]
    return value


def sketch_of(text: bytes | None, shingle: int = 5, bits: int = 256) -> bytes:
    """One bit per bin of the smallest shingle hash that falls into it; empty bins borrow from others.

    Two texts agree in a share (1 + J) / 2 of the bits on average, J being the
    Jaccard similarity of their shingles.
    """
    h = shingles_of(text, shingle)
    return _sketch(_smallest(h, bits)) if len(h) else bytes(bits // 8)


def _sketch(value: np.ndarray) -> bytes:
    return np.packbits(((value * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(63)).astype(bool)).tobytes()


def _bands(value: np.ndarray, bands: int, rows: int) -> list[int]:
    """Keys of ``bands`` groups of ``rows`` bins, taken from all over the table."""
    picked = value[np.arange(bands * rows) * len(value) // (bands * rows)]
    return [xxhash.xxh64_intdigest(picked[b * rows : (b + 1) * rows].tobytes(), b) - (1 << 63) for b in range(bands)]


def _exact_links(sets: DataFrame, similarity: float, piece: int) -> DataFrame:
    """``a, b``: forests of the rows ``comp, rep, set`` of a group whose sets have that Jaccard similarity.

    A large group is cut into pieces; every pair of pieces is one unit of work.
    """
    sizes = sets.groupBy("comp").agg(F.ceil(F.count("*") / piece).alias("parts"))
    spread = sets.join(sizes, "comp").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    units = spread.select("comp", "rep", "set", "part", other).select(
        "comp", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "rep", "set"
    )
    units = units.repartition("comp", "p", "q").sortWithinPartitions("comp", "p", "q", "part")

    def linked(unit, rows):
        left, right = ([(rep, s) for part, rep, s in rows if part == side] for side in unit[1:])
        hits = _alike([s for _, s in left], [s for _, s in right], similarity) if left and right else np.zeros((0, 0), bool)
        ids = np.array([rep for rep, _ in left + right], np.int64)
        i, j = np.nonzero(hits)
        roots = _roots(len(ids), i, j + len(left), ids)
        keep = ids != roots
        return ids[keep], roots[keep]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("comp", "p", "q", "part", "rep", "set"))
            for comp, p, q, part, rep, data in zip(*columns):
                if (comp, p, q) != now:
                    if held:
                        a, b = linked(now, held)
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                    now, held = (comp, p, q), []
                held.append((part, rep, np.frombuffer(data, np.uint64)))
        if held:
            a, b = linked(now, held)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return batches_of(units, compare, "a long, b long")


def _similar_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    reach: int = 11,
    least_match: float = 0.855,
    similarity: float = 0.8,
    bands: int = 10,
    rows_per_band: int = 4,
    piece: int = 256,
) -> DataFrame:
    """``doc_id, t, first`` of documents whose sets of shingles have a Jaccard similarity of at least ``similarity``.

    Candidates come from two sides. Fingerprints of such texts differ in 9.7 of
    64 bits on average, so a reach of eleven meets three quarters of the pairs
    at 0.8; a sketch of 256 bits turns unrelated short texts away. Ten bands of
    four smallest shingle hashes meet 0.995 of them. Within the groups that the
    candidates form, the sets themselves are compared, and only pairs of that
    similarity link. Rows with a null id and texts without words are in no
    group and not returned. ``t`` is a hash of the text, ``first`` the smallest ``(doc_id, t)`` of the group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            fps = np.array([fingerprint_of(t, shingle) for t in texts], np.uint64)
            made, keys, sketches = [], [], []
            for t in texts:
                h = shingles_of(t, shingle)
                value = _smallest(h)
                made.append(xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63))
                keys.append(_bands(value, bands, rows_per_band))
                sketches.append(_sketch(value))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("t"), pa.array(fps.view(np.int64)), pa.array(sketches, pa.binary()), pa.array(made, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "t", "fp", "sketch", "made", "keys"],
            )

    rows = rows_of(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    rows = rows.filter("doc_id is not null").filter(F.col("text").cast("string").rlike(WORD))
    hashed = rows.select("doc_id", F.xxhash64("text").alias("t"), "text")
    prints = cut(batches_of(hashed, run, "doc_id long, t long, fp long, sketch binary, made long, keys array<long>"))
    # Texts with the same set of shingles are one; what is searched is one of them, and its id may be another row's too.
    classes = cut(prints.groupBy("made").agg(F.min(F.struct("doc_id", "fp", "sketch", "keys")).alias("one")).select("made", "one.*"))
    met = links(classes.select("fp", F.col("made").alias("rep"), "sketch"), reach, tables=4, least_match=least_match)
    keyed = classes.select("made", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("made").alias("hub"), F.max("made").alias("last")).filter("hub <> last").select("key", "hub")
    groups = components(met.union(keyed.join(cut(hubs), "key").filter("made <> hub").select("made", "hub"))).withColumnRenamed("node", "made")
    wanted = classes.select("made", "doc_id").join(groups, "made").select("made", "doc_id", F.col("component").alias("comp"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles_of(t.as_py(), shingle) for t in batch.column("text")]
            # Of rows that share the id only the one that the class was made from counts.
            own = pa.array([xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63) == m for h, m in zip(found, batch.column("made").to_pylist())])
            columns = [batch.column("comp"), batch.column("made"), pa.array([h.tobytes() for h in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["comp", "rep", "set"]).filter(own)

    read = batches_of(rows.join(wanted, "doc_id").select("text", "made", "comp"), sets, "comp long, rep long, set binary")
    parts = components(_exact_links(cut(read.dropDuplicates(["rep"])), similarity, piece)).withColumnRenamed("node", "made")
    placed = prints.select("doc_id", "t", "made").join(parts, "made", "left")
    placed = placed.select("doc_id", "t", F.coalesce("component", "made").alias("comp"))
    first = placed.groupBy("comp").agg(F.min(F.struct("doc_id", "t")).alias("first"))
    return placed.join(first, "comp").select("doc_id", "t", "first")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, component_id``: the groups of ``_similar_texts`` by their smallest ids, one row per row of ``docs`` with words and an id."""
    return _similar_texts(docs, id_col, text_col, **options).select("doc_id", F.col("first.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stand for their group of similar documents: the smallest id of each.

    Rows with a null id and texts without words stay. Rows that repeat id and
    text share their fate; of several texts of an id each has its own.
    """
    found = _similar_texts(docs, id_col, text_col, **options)
    drop = found.filter(F.struct("doc_id", "t") != F.col("first")).select(F.col("doc_id").alias("__drop"), F.col("t").alias("__t")).distinct()
    text = F.xxhash64(F.col(f"`{text_col}`").cast("binary"))
    return docs.join(drop, (docs[id_col].cast("long") == drop["__drop"]) & (text == drop["__t"]), "left_anti")
