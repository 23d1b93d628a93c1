"""Language-model scores by context-tree weighting over binary-decomposed bytes.

Every byte is eight binary decisions, each with its own context tree over the
``DEPTH`` bytes before. A node of a tree holds a Krichevsky-Trofimov estimate
of its training counts; its weight against its children is the posterior of the
context-tree mixture, computed from the leaves upwards. A byte's probability
mixes the estimates of all depths along its context. A context that training
never saw has no estimate, and the next shorter one answers for it.

The corpus is cut into blocks. A block counts its distinct (context, byte)
pairs and words and sends them, packed, to parts by the three nearest context
bytes; a part holds whole subtrees, computes their weights and sends every
block the values of exactly the pairs it asked for. Only the tree's top, at
most 2^24 nodes whatever the corpus, passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerloom.llm.common import batches_of, rows_of
from careerloom.runtime import cut

DEPTH = 5
TOP = 2
#: Signs that UTF-8 never uses: before a text, and after it.
BEFORE, AFTER = b"\xfe", b"\xff"
LN10 = np.log(10)


def _packed(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a), codec="zstd", asbytes=True) if len(a) else b""


def _unpacked(data: bytes, kind, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind) if n else np.empty(0, kind)


def _packed_keys(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _unpacked_keys(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpacked(data, np.uint64, n), dtype=np.uint64)


def pair_keys(texts: list[bytes]) -> np.ndarray:
    """One number per position of the texts and their ends: nearest context byte first, the byte itself last."""
    b = np.frombuffer(b"".join(BEFORE * DEPTH + t + AFTER for t in texts), np.uint8).astype(np.uint64)
    keys = b[DEPTH:].copy()
    for d in range(1, DEPTH + 1):
        keys |= b[DEPTH - d : len(b) - d] << np.uint64(8 * (DEPTH + 1 - d))
    starts = np.cumsum([0] + [len(t) + 1 + DEPTH for t in texts])[:-1]
    keep = np.ones(len(b), bool)
    keep[(starts[:, None] + np.arange(DEPTH)).ravel()] = False
    return keys[keep[DEPTH:]]


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after seven steps upwards; for x >= 1/2."""
    product = x.copy()
    for k in range(1, 7):
        product *= x + k
    y = x + 7
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


def _log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.where(n0 + n1 > 0, _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - np.log(np.pi) - _lgamma(n0 + n1 + 1.0), 0.0)


class _Level:
    """Nodes of one depth and bit: ids, estimate of a one, whether seen, own weight, log probability."""

    def __init__(self, ids, n0, n1, below):
        self.ids, self.n0, self.n1 = ids, n0, n1
        kt = _log_kt(n0, n1)
        self.one = (n1 + 0.5) / (n0 + n1 + 1)
        self.seen = n0 + n1 > 0
        self.log_p = kt if below is None else np.logaddexp(kt, below) - np.log(2)
        self.weight = np.ones(len(ids)) if below is None else np.exp(kt - np.log(2) - self.log_p)


def _above(ids: np.ndarray, bit: int) -> np.ndarray:
    """The same decision in the context shorter by its oldest byte."""
    return (ids >> np.uint64(8 + bit)) << np.uint64(bit) | ids & np.uint64((1 << bit) - 1)


def _summed_below(ids: np.ndarray, child: _Level, bit: int) -> np.ndarray:
    return np.bincount(np.searchsorted(ids, _above(child.ids, bit)), child.log_p, len(ids))


def subtrees(keys: np.ndarray, counts: np.ndarray) -> dict[tuple[int, int], _Level]:
    """All nodes of depths above ``TOP`` over sorted distinct pairs and their training counts."""
    levels: dict[tuple[int, int], _Level] = {}
    for depth in range(DEPTH, TOP, -1):
        short = (keys >> np.uint64(8 * (DEPTH + 1 - depth))) << np.uint64(8) | keys & np.uint64(0xFF)
        pairs, where = np.unique(short, return_inverse=True)
        n = np.bincount(where, counts, len(pairs))
        for bit in range(8):
            ids = pairs >> np.uint64(8 - bit)
            at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            one = (pairs >> np.uint64(7 - bit) & np.uint64(1)).astype(float)
            n1 = np.add.reduceat(n * one, at)
            n0 = np.add.reduceat(n * (1 - one), at)
            ids = ids[at]
            below = None if depth == DEPTH else _summed_below(ids, levels[depth + 1, bit], bit)
            levels[depth, bit] = _Level(ids, n0, n1, below)
    return levels


def top_levels(summary) -> dict[tuple[int, int], _Level]:
    """The tree's top from sums over the nodes right below: columns bit, id, n0, n1, below."""
    levels: dict[tuple[int, int], _Level] = {}
    for bit in range(8):
        mine = summary[summary["bit"] == bit].sort_values("id")
        ids = mine["id"].to_numpy().astype(np.uint64)
        n0, n1, below = (mine[c].to_numpy().astype(float) for c in ("n0", "n1", "below"))
        levels[TOP, bit] = _Level(ids, n0, n1, below)
        for depth in range(TOP - 1, -1, -1):
            child = levels[depth + 1, bit]
            ids, where = np.unique(_above(child.ids, bit), return_inverse=True)
            n0, n1, below = (np.bincount(where, x, len(ids)) for x in (child.n0, child.n1, child.log_p))
            levels[depth, bit] = _Level(ids, n0, n1, below)
    return levels


def log10_probabilities(keys: np.ndarray, levels: dict[tuple[int, int], _Level]) -> np.ndarray:
    """log10 of the mixed probability of every pair's byte in its context."""
    out = np.zeros(len(keys))
    for bit in range(8):
        p, seen = np.full(len(keys), 0.5), np.zeros(len(keys), bool)
        for depth in range(DEPTH, -1, -1):
            level = levels[depth, bit]
            context = keys >> np.uint64(8 * (DEPTH + 1 - depth)) if depth else np.zeros(len(keys), np.uint64)
            ids = context << np.uint64(bit) | (keys & np.uint64(0xFF)) >> np.uint64(8 - bit)
            at = np.searchsorted(level.ids, ids)
            at = np.minimum(at, max(0, len(level.ids) - 1))
            if not len(level.ids):
                continue
            one, weight, known = level.one[at], level.weight[at], level.seen[at] & (level.ids[at] == ids)
            mixed = np.where(seen, weight * one + (1 - weight) * p, one)
            p, seen = np.where(known, mixed, p), seen | known
        one = (keys >> np.uint64(7 - bit) & np.uint64(1)).astype(bool)
        out += np.log(np.where(one, p, 1 - p))
    return out / LN10


def _word_keys(text: bytes) -> np.ndarray:
    """64-bit hashes of a text's words and of its end, which is a token of its own."""
    words = text.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, [*words, AFTER]), np.uint64, len(words) + 1)


SCHEMA = "kind byte, part int, block long, n long, keys binary, data binary"
_TYPES = (pa.int8(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
_NAMES = ["kind", "part", "block", "n", "keys", "data"]
PAIRS, WORDS, TEXTS = 0, 1, 2


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


def _part_of(kind: int, keys: np.ndarray, parts: int) -> np.ndarray:
    key = keys >> np.uint64(8 * (DEPTH - TOP)) if kind == PAIRS else keys
    key = (key ^ key >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return ((key >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keys, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([n for _, n in found]), len(keys)).astype(np.int64)


def _distinct(texts: list[bytes], train: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Distinct pairs and words of a block's texts, sorted, with their counts in the training texts."""
    found: dict[int, list] = {PAIRS: [], WORDS: []}
    for start, end in _runs(texts, 2 << 20):
        for learn in (True, False):
            mine = [t for t, f in zip(texts[start:end], train[start:end]) if f == learn]
            if mine:
                for kind, keys in ((PAIRS, pair_keys(mine)), (WORDS, np.concatenate([_word_keys(t) for t in mine]))):
                    keys, n = np.unique(keys, return_counts=True)
                    found[kind].append((keys, n * int(learn)))
        for kind in found:
            if len(found[kind]) > 8:
                found[kind] = [_merged(found[kind])]
    return {kind: _merged(found[kind]) for kind in found}


def _runs(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` bytes together, or of one longer text."""
    start = 0
    while start < len(texts):
        end, n = start, 0
        while end < len(texts) and (end == start or n + len(texts[end]) <= most):
            n += len(texts[end])
            end += 1
        yield start, end
        start = end


def _dealt(kind: int, keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Parts and the positions of their keys, in key order."""
    part = _part_of(kind, keys, parts)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.unique(part).tolist():
        yield p, order[cuts[p] : cuts[p + 1]]


def _gather(parts: int, block_bytes: int):
    """A task's texts in blocks: the texts themselves, packed, and every block's counts by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, blocks = TaskContext.get().partitionId() << 24, 0
        held: list[tuple] = []
        size = 0

        def block():
            nonlocal held, size, blocks
            if held:
                ids, flags, texts = zip(*held)
                for start, end in _runs(texts, 1 << 20):
                    batch = pa.RecordBatch.from_arrays(
                        [pa.array(ids[start:end], pa.int64()), pa.array(flags[start:end], pa.bool_()), pa.array(texts[start:end], pa.binary())],
                        names=["doc_id", "train", "text"],
                    )
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write_batch(batch)
                    yield _rows([(TEXTS, start, base + blocks, end - start, b"", sink.getvalue().to_pybytes())])
                for kind, (keys, n) in _distinct(texts, np.array(flags, bool)).items():
                    out = [
                        (kind, p, base + blocks, len(at), _packed_keys(keys[at]), _packed(n[at].astype(np.uint32)))
                        for p, at in _dealt(kind, keys, parts)
                    ]
                    yield _rows(out)
                held, size, blocks = [], 0, blocks + 1

        for batch in batches:
            for i, train, text in zip(*(batch.column(c) for c in ("doc_id", "train", "text"))):
                text = (text.as_py() or b"").lower()
                held.append((i.as_py(), train.as_py(), text))
                size += len(text)
                if size >= block_bytes:
                    yield from block()
        yield from block()

    return run


def _per_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of one (kind, part) at a time."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c) for c in _NAMES)):
            row = tuple(x.as_py() for x in row)
            if row[:2] != now and rows:
                yield rows
                rows = []
            now = row[:2]
            rows.append(row)
    if rows:
        yield rows


def score(
    docs: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = 14 << 20,
    parts: int | None = None,
) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row, whole texts.

    The model learns from the rows where ``learn`` holds. Texts are read in
    lower case (A-Z); null counts as empty. ``score`` is the log10 probability
    of the text and its end under the model, ``base_score`` that of its words
    and end under add-one word counts; words are told apart by 64-bit hashes.
    Without training rows every bit has probability one half and all words are
    unknown. Repeated rows come back as often as they came.

    A block and a part send each other one row, so ``block_bytes`` and
    ``parts`` (the session's shuffle partitions, 4096 at most) bound the rows.
    """
    spark = docs.sparkSession
    parts = parts or min(4096, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows_of(docs.withColumn("__train", F.coalesce(learn, F.lit(False))), id_col, text_col, "__train").select(
        F.col(id_col).cast("long").alias("doc_id"), F.col("__train").alias("train"), F.col(text_col).cast("binary").alias("text")
    )
    gathered = cut(batches_of(rows, _gather(parts, block_bytes), SCHEMA))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _per_part(batches):
            keys, n = _merged([(_unpacked_keys(r[4], r[3]), _unpacked(r[5], np.uint32, r[3])) for r in rows])
            levels = subtrees(keys, n)
            for bit in range(8):
                level = levels[TOP + 1, bit]
                ids, where = np.unique(_above(level.ids, bit), return_inverse=True)
                sums = [np.bincount(where, x, len(ids)) for x in (level.n0, level.n1, level.log_p)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), bit, np.int8)), pa.array(ids.astype(np.int64)), *map(pa.array, sums)],
                    names=["bit", "id", "n0", "n1", "below"],
                )

    by_part = gathered.filter(F.col("kind") == PAIRS).repartition(parts, "part").sortWithinPartitions("kind", "part", "block")
    summary = batches_of(by_part, summarise, "bit byte, id long, n0 double, n1 double, below double")
    # At most 256^TOP contexts with 255 decisions each.
    summary = summary.groupBy("bit", "id").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "below"))).toPandas()
    top = spark.sparkContext.broadcast(top_levels(summary))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _per_part(batches):
            asked = [_unpacked_keys(r[4], r[3]) for r in rows]
            keys, n = _merged([(k, _unpacked(r[5], np.uint32, r[3])) for k, r in zip(asked, rows)])
            if rows[0][0] == PAIRS:
                values = log10_probabilities(keys, {**subtrees(keys, n), **top.value}).astype(np.float32)
            else:
                values = n
                totals = np.array([n.sum(), (n > 0).sum()], np.int64)
                yield _rows([(WORDS, rows[0][1], -1, 2, b"", totals.tobytes())])
            for r, k in zip(rows, asked):
                # In the order of the block's own keys, which it can make again from its texts.
                yield _rows([(r[0], r[1], r[2], r[3], b"", _packed(values[np.searchsorted(keys, k)]))])

    asked = gathered.filter(F.col("kind") != TEXTS).repartition(2 * parts, "kind", "part").sortWithinPartitions("kind", "part", "block")
    answers = cut(batches_of(asked, answer, SCHEMA))
    # Two numbers per part.
    totals = [np.frombuffer(r["data"], np.int64) for r in answers.filter("block = -1").select("data").collect()]
    n_train, n_distinct = (int(x) for x in np.sum(totals, axis=0)) if totals else (0, 0)
    scale = np.log10(n_train + n_distinct + 1)

    def judged_block(values: dict[tuple[int, int], np.ndarray], packed: list[bytes]) -> Iterator[pa.RecordBatch]:
        tables = [pa.ipc.open_stream(x).read_all().combine_chunks() for x in packed]
        texts = [t for x in tables for t in x.column("text").to_pylist()]
        train = np.concatenate([x.column("train").to_numpy() for x in tables])
        value_of = {}
        for kind, (keys, _) in _distinct(texts, train).items():
            v = np.empty(len(keys))
            for p, at in _dealt(kind, keys, parts):
                v[at] = values[kind, p]
            value_of[kind] = keys, v
        for x in tables:
            texts = x.column("text").to_pylist()
            keys, v = value_of[PAIRS]
            cuts = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
            scores = np.add.reduceat(v[np.searchsorted(keys, pair_keys(texts))], cuts)
            words = [_word_keys(t) for t in texts]
            sizes = np.array([len(w) for w in words])
            cuts = np.cumsum(sizes) - sizes
            keys, v = value_of[WORDS]
            c = v[np.searchsorted(keys, np.concatenate(words))]
            base = np.add.reduceat(np.log10(c + 1), cuts) - sizes * scale
            known = np.add.reduceat((c > 0).astype(np.int64), cuts)
            yield pa.RecordBatch.from_arrays(
                [x.column("doc_id").combine_chunks(), x.column("train").combine_chunks(), *map(pa.array, (sizes.astype(np.int64), known, base, scores))],
                names=["doc_id", "train", "n_tokens", "n_known", "base_score", "score"],
            )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, values, packed = None, {}, []
        for batch in batches:
            for row in zip(*(batch.column(c) for c in _NAMES)):
                kind, part, block, n, _, data = (x.as_py() for x in row)
                if block != now:
                    if packed:
                        yield from judged_block(values, packed)
                    now, values, packed = block, {}, []
                if kind == TEXTS:
                    packed.append(data)
                else:
                    values[kind, part] = _unpacked(data, np.float32 if kind == PAIRS else np.int64, n)
        if packed:
            yield from judged_block(values, packed)

    together = gathered.filter(F.col("kind") == TEXTS).union(answers.filter("block >= 0"))
    together = together.repartition("block").sortWithinPartitions("block", "kind", "part")
    judged = batches_of(together, judge, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return judged.select("doc_id", "train", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
