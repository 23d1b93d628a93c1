"""Substring dedup: paragraph MinHash banding, exact Jaccard, components, and removal of the later copies.

Passages repeat in the middle of lines, so the text itself says where a
paragraph starts: at the words whose hash is the smallest of ``gap`` in a row.
A passage of ``length + gap - 1`` words (50) thus holds a whole paragraph of
``length`` words with the same start wherever it stands. Equal paragraphs are
compared with their surroundings: each run of ``least`` words around them is
looked up by its own first occurrence, so every exact repeat of that size is found.

For near copies, the ``near`` words from a start get MinHash bands over five-word
shingles; different ones that collide in a band are compared by exact Jaccard.
In 50 words one changed inner word leaves a similarity of 0.804. Three bands of
two rows find a pair of similarity 0.8 with probability 0.95. Of every component
the first occurrence stays; the others are joined to stretches and extended word
by word along it. A stretch of ``least`` words or more is a repeated passage.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from careerloom.llm.common import WORD, batches_of, rows_of, words_of
from careerloom.llm.components import components
from careerloom.runtime import buckets_for, cut, cut_by, discard

_WORD = re.compile(WORD)


class _Hashes(dict):
    """Word -> 32-bit hash; bounded by starting over."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = zlib.crc32(word)
        h = (h ^ (h >> 16)) * 0x45D9F3B & 0xFFFFFFFF
        h ^= h >> 15
        if len(word) <= 64:
            self[word] = h
        return h


_hashes = _Hashes()


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


#: Odd multipliers, one per hash of a MinHash.
_ODD = _mixed(np.arange(1, 65, dtype=np.uint64), 3) | np.uint64(1)


def _rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` neighbours."""
    out = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        out = (out * np.uint64(0x100000001B3)) ^ h[i : i + len(out)]
    return _mixed(out, 0)


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        a, done = np.minimum(a[:-done], a[done:]), 2 * done
    return np.minimum(a[: len(a) - (width - done)], a[width - done :]) if done < width else a


def _lowest(a: np.ndarray, width: int, most: int = 1 << 23) -> np.ndarray:
    """Positions of the first smallest of every ``width`` neighbours, piece by piece for very long texts."""
    found = []
    for start in range(0, len(a) - width + 1, most):
        part = a[start : start + most + width - 1]
        # Value and position in one number: the smallest names its place.
        coded = (part & ~np.uint64(0xFFFFFF)) | np.arange(len(part), dtype=np.uint64)
        low = _sliding_min(coded, width) & np.uint64(0xFFFFFF)
        keep = np.ones(len(low), bool)
        keep[1:] = low[1:] != low[:-1]
        found.append(low[keep].astype(np.int64) + start)
    return np.unique(np.concatenate(found))


class _Windows:
    """Hashes of any runs of words of one text, each in constant time."""

    def __init__(self, h: np.ndarray):
        base, back = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 2**64)
        powers = np.full(len(h) + 1, base, np.uint64)
        self.back = np.full(len(h) + 1, back, np.uint64)
        powers[0] = self.back[0] = 1
        powers, self.back = np.cumprod(powers), np.cumprod(self.back)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(h, 5) * powers[:-1])])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start], 6)


@dataclass(frozen=True)
class Shape:
    """Words per paragraph, distance of starts, words per shingle, words per paragraph compared by similarity, bands and rows per band."""

    length: int = 20
    gap: int = 31
    shingle: int = 5
    near: int = 50
    bands: int = 3
    rows: int = 2
    anchor: int = 3

    def starts(self, h: np.ndarray) -> np.ndarray:
        """Starts of whole paragraphs: the first smallest of ``gap`` hashes in a row, whatever surrounds them."""
        a = _rolled(h, self.anchor)
        n = len(h) - self.length + 1
        if n <= 0:
            return np.empty(0, np.int64)
        a = a[:n]
        if len(a) < self.gap:
            return np.array([a.argmin()])
        return _lowest(a, self.gap)

    def signatures(self, h: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of starts in texts that lie one behind the other: hash of the paragraph, of paragraph and surroundings, words on
        the right, whether ``near`` words follow; then, for starts that have these, their hash and band keys.

        ``begin`` and ``end`` are the bounds of each start's text.
        """
        windows = _Windows(h)
        room, left = np.minimum(self.gap, end - at - self.length), np.minimum(self.gap, at - begin)
        content = windows.between(at, at + self.length)
        around = windows.between(at - left, at + self.length + room) ^ _mixed((left * 64 + room).astype(np.uint64), 7)
        enough = at + self.near <= end
        at = at[enough]
        keys = np.empty((len(at), self.bands), np.uint64)
        if len(at):
            grams = _rolled(h, self.shingle)
            for b in range(self.bands):
                key = np.full(len(at), b, np.uint64)
                for r in range(self.rows):
                    # Shingles are mixed hashes, so a product with an odd number orders them anew; half its bits are enough.
                    m = ((grams * _ODD[b * self.rows + r]) >> np.uint64(32)).astype(np.uint32)
                    least = _sliding_min(m, self.near - self.shingle + 1)[at].astype(np.uint64)
                    key = _mixed(key * np.uint64(31) + least, 77)
                keys[:, b] = key
        near = windows.between(at, at + self.near)
        return content.view(np.int64), around.view(np.int64), room.astype(np.int8), enough, near.view(np.int64), keys.view(np.int64)

    def sets(self, words: np.ndarray) -> np.ndarray:
        """Shingles of paragraphs, one row each, from their word hashes."""
        out = np.zeros((len(words), self.near - self.shingle + 1), np.uint64)
        for i in range(self.shingle):
            out = (out * np.uint64(0x100000001B3)) ^ words[:, i : i + out.shape[1]]
        return _mixed(out, 0)


def _word_hashes(text: bytes | None) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def _alike(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which rows of two shingle tables have a Jaccard similarity of at least ``least``."""
    sets_a, sets_b = [np.unique(x) for x in a], [np.unique(x) for x in b]
    out = np.zeros((len(a), len(b)), bool)
    # An inverted list of b's shingles gives all overlaps of one row of a at once.
    flat = np.concatenate(sets_b)
    owner = np.repeat(np.arange(len(b)), [len(x) for x in sets_b])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    size_b = np.array([len(x) for x in sets_b])
    for i, x in enumerate(sets_a):
        lo, hi = np.searchsorted(flat, x), np.searchsorted(flat, x, "right")
        n = hi - lo
        at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        both = np.bincount(owner[at], minlength=len(b))
        out[i] = both >= least * (len(x) + size_b - both) - 1e-9
    return out


def _colliding(found: DataFrame) -> DataFrame:
    """``key, cls, doc``: different paragraphs that share a band, each once per band, with the first document that has them.

    Paragraphs first seen in one document are no candidates for each other: whoever has one of them repeats that
    document exactly. Overlapping paragraphs of a text would otherwise be most of all candidates.
    """
    names, schema = ["key", "cls", "doc"], "key long, cls long, doc long"

    def once_per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("keys")
            sizes = np.diff(keys.offsets.to_numpy())
            rows = [keys.flatten().to_numpy(), *(np.repeat(batch.column(c).to_numpy(), sizes) for c in ("cls", "doc"))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _first_of(*rows)], names=names)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by key, paragraph and document, those of keys with several documents.

        Holds back the last key's rows while they are of one document, else its last row.
        """
        held = [np.empty(0, np.int64)] * 3
        told = None  # the key whose rows, all but new ones, were passed on
        for batch in batches:
            n_held = len(held[0])
            rows = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, names)]
            if not len(rows[0]):
                continue
            new = np.ones(len(rows[0]), bool)
            new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
            old = np.cumsum(new)[n_held - 1] if n_held else 0
            key, cls, doc = (x[new] for x in rows)
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
            several |= key[first] == told if told is not None else False
            out = np.repeat(several, np.diff([*first, len(key)]))
            open_ = first[-1]
            if key[0] == told:
                out[:old] = False
            told = int(key[-1]) if several[-1] else None
            # A key of one document so far may still meet another one.
            held = [x[open_:] if told is None else x[-1:] for x in (key, cls, doc)]
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (key, cls, doc)], names=names)

    rows = batches_of(found.select("cls", "keys", F.col("doc_id").alias("doc")), once_per_task, schema)
    return batches_of(rows.repartition("key").sortWithinPartitions(*names), shared, schema)


def _first_of(key: np.ndarray, cls: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """The smallest document of every key and paragraph."""
    order = np.lexsort((doc, cls, key))
    key, cls, doc = key[order], cls[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
    return [key[new], cls[new], doc[new]]


def _unique_pairs(pairs: np.ndarray) -> np.ndarray:
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    keep = np.ones(len(pairs), bool)
    keep[1:] = (pairs[1:] != pairs[:-1]).any(1)
    return pairs[keep]


def _near_classes(members: DataFrame, words: DataFrame, shape: Shape, similarity: float, piece: int) -> DataFrame:
    """Spanning forests ``cls, root`` of the links between different paragraphs that share a band."""
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / piece).alias("parts"))
    # A large bucket is cut into pieces; every pair of pieces is one unit of work.
    spread = members.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    units = spread.select("key", "cls", "doc", "part", other).select(
        "key", "cls", "doc", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q")
    )
    units = units.join(words, "cls").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "part")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple | None = None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("key", "p", "q")], axis=1)
            words = np.frombuffer(b"".join(batch.column("words").to_pylist()), "<u4").reshape(len(key), -1)
            rows = key, *(batch.column(c).to_numpy() for c in ("cls", "doc", "part")), words
            if rest is not None:
                rows = tuple(np.concatenate(x) for x in zip(rest, rows))
            # The last unit may go on in the next batch.
            last = np.flatnonzero((np.diff(rows[0], axis=0) != 0).any(1))
            cut_at = last[-1] + 1 if len(last) else 0
            rest = tuple(x[cut_at:] for x in rows)
            if cut_at:
                yield from _forest_of_units(*(x[:cut_at] for x in rows), shape, similarity)
        if rest is not None and len(rest[0]):
            yield from _forest_of_units(*rest, shape, similarity)

    return batches_of(units.select("key", "p", "q", "part", "cls", "doc", "words"), compare, "cls long, root long")


def _roots(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id that each of ``n`` nodes reaches over the links (i, j)."""
    roots = ids.copy()
    while True:
        low = np.minimum(roots[i], roots[j])
        new = roots.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == roots).all():
            return roots
        roots = new


def _forest_of_units(key, cls, doc, part, words, shape: Shape, similarity: float, small: int = 32, step: int = 20_000) -> Iterator[pa.RecordBatch]:
    """``cls, root`` of whole units: pairs of small ones all at once, a large one by its inverted list."""
    tables = np.sort(shape.sets(words.astype(np.uint64)), axis=1)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(key, axis=0) != 0).any(1)]))
    sizes = np.diff([*first, len(key)])
    one, other = _distinct(tables, 0), _distinct(tables, 1)
    links: list[tuple[np.ndarray, np.ndarray]] = []
    for size in np.unique(sizes[sizes <= small]):
        if size < 2:
            continue
        at = first[sizes == size]
        x, y = np.triu_indices(size, 1)
        i, j = (at[:, None] + x).ravel(), (at[:, None] + y).ravel()
        cross = (part[i] != part[j]) | (key[i, 1] == key[i, 2])  # within one piece only where the unit is that piece
        cross &= doc[i] != doc[j]
        i, j = i[cross], j[cross]
        for s in range(0, len(i), step):
            a, b = i[s : s + step], j[s : s + step]
            alike = _jaccard((one[0][a], one[1][a]), (other[0][b], other[1][b])) >= similarity - 1e-9
            links.append((a[alike], b[alike]))
    for s, size in zip(first[sizes > small], sizes[sizes > small]):
        left = np.flatnonzero(part[s : s + size] == key[s, 1]) + s
        right = np.flatnonzero(part[s : s + size] == key[s, 2]) + s
        i, j = np.nonzero(_alike(tables[left], tables[right], similarity) & (doc[left][:, None] != doc[right]))
        links.append((left[i], right[j]))
    if links:
        i, j = (np.concatenate(x) for x in zip(*links))
        roots = _roots(len(cls), i, j, cls)
        pairs = _unique_pairs(np.column_stack([cls, roots])[cls != roots])
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["cls", "root"])


def _distinct(table: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted rows with repeats replaced by numbers of their own, and how many values a row has."""
    repeat = np.zeros(table.shape, bool)
    repeat[:, 1:] = table[:, 1:] == table[:, :-1]
    own = np.broadcast_to(_mixed(np.arange(table.shape[1], dtype=np.uint64), 11 + salt), table.shape)
    return np.where(repeat, own, table), table.shape[1] - repeat.sum(1)


def _jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Jaccard similarity of the sets in the rows of two tables that ``_distinct`` made, row by row."""
    (left, n), (right, m) = a, b
    # What a row of the one has in common with that of the other lies side by side when both are sorted together; the
    # numbers that stand for repeats differ between the two.
    merged = np.sort(np.concatenate([left, right], axis=1), axis=1)
    both = (merged[:, 1:] == merged[:, :-1]).sum(1)
    return both / (n + m - both)


def _met(table: pa.Table, least: int, length: int, names: list[str]) -> pa.RecordBatch:
    """The stretches that the runs ``words`` around places share with the first place of each run."""
    lists = table.column("words").combine_chunks()
    runs, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    doc, loc = (np.repeat(table.column(c).to_numpy(), sizes) for c in ("doc_id", "loc"))
    pos = loc & 0xFFFFFFFF
    start = np.maximum(0, pos + length - least) + np.arange(len(runs)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.lexsort((start, loc, doc, runs))
    runs, doc, loc, pos, start = (x[order] for x in (runs, doc, loc, pos, start))
    first = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]])) if len(runs) else np.empty(0, np.int64)
    lead = np.repeat(first, np.diff([*first, len(runs)]))
    hit = doc != doc[lead]
    m_doc, m_t, m_pos = doc[lead], loc[lead] >> 32, pos + start[lead] - start
    same = [x[hit] for x in (doc, loc, m_doc, m_t, m_pos)]
    reach = (start - pos)[hit]
    order = np.lexsort((reach, *same))
    same, reach = [x[order] for x in same], reach[order]
    new = np.ones(len(reach), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in same], axis=0)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(reach)]])[: len(first)] - 1
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (*(x[first] for x in same), reach[first], reach[last] + least)], names=names)


def repeated_passages(
    docs: DataFrame,
    similarity: float = 0.8,
    least: int = 50,
    shape: Shape = Shape(),
    piece: int = 1024,
    few: int = 64,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, start_word, n_words, removed, kept_doc_id``: one row per repeated passage of a document.

    ``removed`` passages occur before, in the document ``kept_doc_id``; the
    other rows are those first occurrences, as far as at least ``least`` of
    their words are not removed themselves. First is the smallest id. Passages
    that one document repeats by itself are left alone. Documents without
    repeated passages, empty and null texts, and rows with a null id have no
    rows. Of rows that repeat id and text one speaks for all; rows that share
    an id but not the text are told apart by ``text_hash``.
    """
    rows = rows_of(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    rows = rows.filter("doc_id is not null and text is not null").select("doc_id", F.hash("text").alias("t"), "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [_word_hashes(text.as_py()).astype("<u4").tobytes() for text in batch.column("text")]
            enough = pa.array([len(w) >= 4 * shape.length for w in words])
            columns = [batch.column("doc_id"), batch.column("t"), pa.array(words, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t", "words"]).filter(enough)

    # The words of every text that is long enough, as hashes: texts are read once, and all later look-ups of places in
    # them join where this table lies.
    buckets = buckets_for(docs)
    texts = cut_by(batches_of(rows, hashed, "doc_id long, t int, words binary"), "doc_id", "t", buckets=buckets, unique=True)

    names = ["doc_id", "loc", "cls", "around", "room", "near", "keys"]

    def signed(texts: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        """Rows of the starts of some texts ``id, hash, words, starts``, all at once."""
        sizes, counts = np.array([len(h) for _, _, h, _ in texts]), np.array([len(at) for *_, at in texts])
        begin = np.repeat(np.cumsum(sizes) - sizes, counts)
        ids, hashes = (np.repeat(np.array(x, np.int64), counts) for x in ([t[0] for t in texts], [t[1] for t in texts]))
        local = np.concatenate([at for *_, at in texts])
        words = np.concatenate([h for _, _, h, _ in texts])
        content, around, room, enough, near, keys = shape.signatures(words, local + begin, begin, begin + np.repeat(sizes, counts))
        # Starts too close to the end of their text have no paragraph to compare by similarity.
        all_near = np.zeros(len(local), np.int64)
        all_near[enough] = near
        ends = np.concatenate([[0], np.cumsum(np.where(enough, shape.bands, 0))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
        columns = ids, (hashes << 32) | local, content, around, room, all_near
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), lists], names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column("doc_id").to_pylist(), batch.column("t").to_pylist()
            some, held = [], 0
            for i, words in enumerate(batch.column("words")):
                h = np.frombuffer(words.as_py(), "<u4").astype(np.uint64)
                at = shape.starts(h)
                if len(at):
                    some.append((ids[i], hashes[i], h, at))
                    held += len(h)
                # Enough words for whole arrays to pay, and few enough to stay near the processor.
                if some and (held >= 100_000 or i + 1 == batch.num_rows):
                    yield signed(some)
                    some, held = [], 0

    # loc: the text's hash and the paragraph's first word in one number.
    found = cut(batches_of(texts, scan, "doc_id long, loc long, cls long, around long, room byte, near long, keys array<long>"))

    def read_at(spots: DataFrame, value, kind: str) -> DataFrame:
        """``doc_id, loc, tag, words``: what ``value`` makes of the word hashes of a text and each of the places in it."""

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column("at")
                offsets = at.offsets.to_numpy() - at.offsets[0].as_py()
                places = at.flatten()
                locs, tags = (places.field(c).to_numpy() for c in ("loc", "tag"))
                ids = np.repeat(batch.column("doc_id").to_numpy(), np.diff(offsets))
                out, first = [], 0
                for i, words in enumerate(batch.column("words")):
                    h = np.frombuffer(words.as_py(), "<u4").astype(np.uint64)
                    out.append(value(h, locs[offsets[i] : offsets[i + 1]] & 0xFFFFFFFF))
                    last = offsets[i + 1]
                    if last - first >= 20_000 or i + 1 == batch.num_rows:
                        columns = [pa.array(x[first:last]) for x in (ids, locs, tags)]
                        yield pa.RecordBatch.from_arrays([*columns, pa.concat_arrays(out)], names=["doc_id", "loc", "tag", "words"])
                        out, first = [], last

        at = spots.select("doc_id", F.shiftright("loc", 32).cast("int").alias("t"), "loc", "tag").repartition(buckets, "doc_id", "t")
        at = at.groupBy("doc_id", "t").agg(F.collect_set(F.struct("loc", "tag")).alias("at"))
        joined = texts.hint("merge").join(at, ["doc_id", "t"]).select("doc_id", "words", "at")
        return batches_of(joined, look, f"doc_id long, loc long, tag long, words {kind}")

    def look_up(spots: DataFrame, before: int, after: int) -> DataFrame:
        """``words``: word hashes from ``before`` words before each of the spots ``doc_id, loc, tag`` to ``after`` behind it."""

        def value(h: np.ndarray, at: np.ndarray) -> pa.Array:
            h = h.astype("<u4")
            return pa.array([h[max(0, pos - before) : pos + after].tobytes() for pos in at.tolist()], pa.binary())

        return read_at(spots, value, "binary")

    def joined_stretches(hits: DataFrame) -> DataFrame:
        """Hits ``s, e`` of a text along the same text at the same distance that touch are one stretch."""
        along = Window.partitionBy("doc_id", "t", "k_doc", "k_t", "off").orderBy("s", "e")
        reached = F.max("e").over(along.rowsBetween(Window.unboundedPreceding, -1))
        fresh = hits.withColumn("fresh", (reached.isNull() | (F.col("s") > reached)).cast("int"))
        runs = fresh.withColumn("no", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        return runs.groupBy("doc_id", "t", "k_doc", "k_t", "off", "no").agg(F.min("s").alias("s"), F.max("e").alias("e"))

    pos = F.col("loc").bitwiseAND(0xFFFFFFFF)
    k_pos = F.col("k_loc").bitwiseAND(0xFFFFFFFF)
    t, k_t = F.shiftright("loc", 32).alias("t"), F.shiftright("k_loc", 32).alias("k_t")
    # Equal paragraphs of several documents. Written before they are joined: only then can Spark split the rows of a
    # paragraph that very many documents have.
    repeated = cut(found.groupBy("cls").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo <> hi").select("cls"))
    spots = cut(found.select("cls", "doc_id", "loc", "around", "room").join(repeated, "cls"))
    # Where the surroundings are equal too, the first occurrence speaks for all. Surroundings that occur once are their
    # own first: only the others are looked up.
    firsts = spots.groupBy("cls", "around").agg(F.min(F.struct("doc_id", "loc")).alias("first"), F.count("*").alias("n"))
    firsts = cut(firsts.select("cls", "around", "n", "first.*"))
    as_first = [F.col("doc_id").alias("k_doc"), F.col("loc").alias("k_loc")]
    firsts_of = firsts.filter("n > 1").select("around", *as_first)
    placed = cut(spots.select("around", "doc_id", "loc", "room").join(firsts_of, "around"))
    discard(repeated, spots)
    copies = placed.filter("doc_id <> k_doc").select(
        "doc_id", t, "k_doc", k_t, (pos - k_pos).alias("off"), (pos - F.least(pos, F.lit(shape.gap))).alias("s"), (pos + shape.length + F.col("room")).alias("e")
    )
    # The others meet in the runs of ``least`` words around the paragraph: each run is compared with its own first
    # occurrence, so that an early document that has less of a passage hides nobody's match.
    several = cut(firsts.groupBy("cls").count().filter("count > 1"))

    def runs_around(h: np.ndarray, at: np.ndarray) -> pa.Array:
        low, high = np.maximum(0, at + shape.length - least), np.minimum(at, len(h) - least)
        n = np.maximum(0, high - low + 1)
        ends = np.cumsum(n)
        start = np.repeat(low - (ends - n), n) + np.arange(n.sum())
        runs = _Windows(h).between(start, start + least).view(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(runs))

    # The tag of a paragraph with few different surroundings is its hash; they are compared in one place. The runs of
    # a frequent one are dealt out one by one.
    tag = F.when((F.col("count") <= few) & (F.col("cls") != 0), F.col("cls")).otherwise(0).alias("tag")
    alone = firsts.join(several, "cls").select("doc_id", "loc", tag)
    windows = runs = cut(read_at(alone, runs_around, "array<long>"))
    discard(several)
    columns = ["doc_id", "loc", "m_doc", "m_t", "m_pos", "lo", "hi"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = pa.RecordBatch.from_pylist([], windows_schema)
        for batch in batches:
            arrays = [batch.column(c).cast(windows_schema.field(c).type) for c in windows_schema.names]
            table = pa.Table.from_batches([rest, pa.RecordBatch.from_arrays(arrays, schema=windows_schema)]).combine_chunks()
            tags = table.column("tag").to_numpy()
            # The last paragraph may go on in the next batch.
            last = np.flatnonzero(np.diff(tags))
            at = int(last[-1]) + 1 if len(last) else 0
            if at:
                yield _met(table.slice(0, at), least, shape.length, columns)
            rest = (table.slice(at).combine_chunks().to_batches() or [rest.slice(0, 0)])[0]
        if rest.num_rows:
            yield _met(pa.Table.from_batches([rest]), least, shape.length, columns)

    windows_schema = pa.schema([("doc_id", pa.int64()), ("loc", pa.int64()), ("tag", pa.int64()), ("words", pa.list_(pa.int64()))])
    small = windows.filter("tag <> 0").repartition("tag").sortWithinPartitions("tag")
    met = batches_of(small, meet, "doc_id long, loc long, m_doc long, m_t long, m_pos long, lo long, hi long")
    start = F.greatest(F.lit(0).cast("long"), pos + shape.length - least)
    windows = windows.filter("tag = 0").select("doc_id", "loc", start.alias("start"), F.posexplode("words").alias("i", "run"))
    windows = windows.select("doc_id", "loc", (F.col("start") + F.col("i")).alias("start"), "run")
    lead = F.min(F.struct("doc_id", "loc", "start"))
    leads = windows.groupBy("run").agg(lead.alias("lead"), F.max("doc_id").alias("last")).filter("lead.doc_id <> last")
    leads = cut(leads.select("run", "lead"))
    dealt = windows.join(leads, "run").filter("doc_id <> lead.doc_id")
    # How far the runs reach before and behind the paragraph's first word.
    dealt = dealt.select(
        "doc_id", "loc", F.col("lead.doc_id").alias("m_doc"), F.shiftright("lead.loc", 32).alias("m_t"),
        (pos + F.col("lead.start") - F.col("start")).alias("m_pos"), (F.col("start") - pos).alias("from"),
    ).groupBy("doc_id", "loc", "m_doc", "m_t", "m_pos").agg(F.min("from").alias("lo"), (F.max("from") + least).alias("hi"))
    # It holds for all places of the document that look alike.
    met = cut(met.union(dealt.select(*columns)).select(F.col("doc_id").alias("k_doc"), F.col("loc").alias("k_loc"), *columns[2:]))
    discard(runs, leads)
    own = placed.filter("doc_id = k_doc").select("doc_id", "loc", "k_doc", "k_loc").union(firsts.filter("n = 1").select("doc_id", "loc", *as_first))
    others = own.join(met, ["k_doc", "k_loc"]).select(
        "doc_id", t, F.col("m_doc").alias("k_doc"), F.col("m_t").alias("k_t"), (pos - F.col("m_pos")).alias("off"), (pos + F.col("lo")).alias("s"), (pos + F.col("hi")).alias("e")
    )
    exact = cut(joined_stretches(copies.union(others)).drop("no"))
    discard(firsts, placed, met)

    # Different paragraphs of ``near`` words that share a band.
    members = cut(_colliding(found.select("doc_id", F.col("near").alias("cls"), "keys").filter(F.size("keys") > 0)))
    wanted = cut(members.select("cls").distinct())
    spots = cut(found.filter(F.size("keys") > 0).select(F.col("near").alias("cls"), "doc_id", "loc").join(wanted, "cls"))
    discard(found, wanted)
    one = spots.groupBy("cls").agg(F.min(F.struct("doc_id", "loc")).alias("one")).select("one.*", F.col("cls").alias("tag"))
    words = look_up(one, 0, shape.near).select(F.col("tag").alias("cls"), "words")
    forest = cut(_near_classes(members, words, shape, similarity, piece))
    discard(members)
    parts = components(forest, "cls", "root").withColumnRenamed("node", "cls")
    parts = cut(parts)
    placed = spots.join(parts, "cls").select("doc_id", "loc", F.col("component").alias("comp"))
    first = placed.groupBy("comp").agg(F.min(F.struct("doc_id", "loc")).alias("lead"), F.max("doc_id").alias("last")).filter("lead.doc_id <> last")
    first = cut(first)
    hits = placed.join(first, "comp").filter("doc_id <> lead.doc_id").select("doc_id", "loc", F.col("lead.doc_id").alias("k_doc"), F.col("lead.loc").alias("k_loc"))
    hits = hits.select("doc_id", t, "k_doc", k_t, (pos - k_pos).alias("off"), pos.alias("s"), (pos + shape.near).alias("e")).distinct()
    name = ["doc_id", "t", "k_doc", "k_t", "off", "no"]
    stretches = cut(joined_stretches(hits))
    discard(spots, forest, parts, first)
    # Both ends are extended word by word along the first occurrence.
    ends = stretches.select(*name, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("s").alias("at")), F.struct(F.lit(1).alias("side"), F.col("e").alias("at")))).alias("end"))
    ends = ends.select(
        *name, "end.side",
        F.shiftleft("t", 32).bitwiseOR(F.col("end.at")).alias("loc"),
        F.shiftleft("k_t", 32).bitwiseOR(F.col("end.at") - F.col("off")).alias("k_loc"),
    )
    places = ends.select("doc_id", "loc").union(ends.select("k_doc", "k_loc")).withColumn("tag", F.lit(0).cast("long"))
    around = cut(look_up(places, shape.gap, shape.gap).drop("tag"))
    discard(texts)
    both = ends.join(around, ["doc_id", "loc"]).join(
        around.select(F.col("doc_id").alias("k_doc"), F.col("loc").alias("k_loc"), F.col("words").alias("k_words")), ["k_doc", "k_loc"]
    )

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = np.zeros(batch.num_rows, np.int64)
            for i, (side, loc, w, k_loc, v) in enumerate(zip(*(batch.column(c) for c in ("side", "loc", "words", "k_loc", "k_words")))):
                a, b = (min(shape.gap, x.as_py() & 0xFFFFFFFF) for x in (loc, k_loc))
                w, v = np.frombuffer(w.as_py(), "<u4"), np.frombuffer(v.as_py(), "<u4")
                # Similar paragraphs may begin and end with words that the other one has not: these are no part of the passage.
                inner, other = (w[:a][::-1], v[::-1]) if side.as_py() else (w[a:], v)
                known = np.isin(_rolled(inner.astype(np.uint64), shape.anchor), _rolled(other.astype(np.uint64), shape.anchor))
                if not known[:1].all() or not len(known):
                    more[i] = -known.argmax() if known.any() else -len(inner)
                    continue
                w, v = (w[a:], v[b:]) if side.as_py() else (w[:a][::-1], v[:b][::-1])
                n = min(len(w), len(v))
                same = w[:n] == v[:n]
                more[i] = n if same.all() else same.argmin()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*name, "side")), pa.array(more)], names=[*name, "side", "more"])

    longer = batches_of(
        both.select(*name, "side", "loc", "words", "k_loc", "k_words"), extend,
        "doc_id long, t long, k_doc long, k_t long, off long, no long, side int, more long",
    )
    longer = longer.groupBy(*name).agg(
        F.max(F.when(F.col("side") == 0, F.col("more"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("more"))).alias("r")
    )
    near = stretches.join(longer, name).select("doc_id", "t", "k_doc", "k_t", "off", (F.col("s") - F.col("l")).alias("s"), (F.col("e") + F.col("r")).alias("e"))
    # Every stretch is long enough by itself.
    matched = cut(exact.unionByName(near).filter(F.col("e") - F.col("s") >= least))
    discard(exact, stretches, around)
    spans = matched.select("doc_id", "t", F.lit(True).alias("removed"), "s", "e", F.col("k_doc").alias("kept")).union(
        matched.select("k_doc", "k_t", F.lit(False), F.col("s") - F.col("off"), F.col("e") - F.col("off"), "k_doc").distinct()
    )
    # Spans of a document that touch become one run.
    along = Window.partitionBy("doc_id", "t", "removed").orderBy("s", "e")
    reached = F.max("e").over(along.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("fresh", (reached.isNull() | (F.col("s") > reached)).cast("int"))
    runs = runs.withColumn("run", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("doc_id", "t", "removed", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min("kept").alias("kept"))
    merged = cut(merged)
    discard(matched)
    # A first occurrence that is removed itself, but for fewer than ``least`` words, is none. How many words are removed
    # before a place follows from the ends of the removed runs before it.
    ends = F.explode(F.array(*(F.struct(F.col(c).alias("at"), F.lit(way).alias("way")) for c, way in (("s", 1), ("e", -1)))))
    ends = merged.withColumn("end", ends).select("*", F.when(F.col("removed"), F.col("end.way")).otherwise(0).alias("way"), F.col("end.at").alias("at"))
    before = Window.partitionBy("doc_id", "t").orderBy("at")
    gone = F.sum(F.col("way") * -F.col("at")).over(before) + F.sum("way").over(before) * F.col("at")
    gone = ends.withColumn("gone", gone).groupBy("doc_id", "t", "removed", "s", "e", "kept").agg((F.max("gone") - F.min("gone")).alias("gone"))
    return gone.filter(F.col("removed") | (F.col("e") - F.col("s") - F.col("gone") >= least)).select(
        "doc_id",
        F.col("t").cast("int").alias("text_hash"),
        F.col("s").cast("long").alias("start_word"),
        (F.col("e") - F.col("s")).cast("long").alias("n_words"),
        "removed",
        F.col("kept").alias("kept_doc_id"),
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the removed passages; a text that loses all its words loses its row.

    The white space before a removed run goes with it. All other rows and
    columns stay as they are.
    """
    found = repeated_passages(docs, id_col=id_col, text_col=text_col, **options).filter("removed")
    spans = found.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start_word", "n_words"))).alias("__spans"))
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__spans")
    hashed = F.hash(F.col(f"`{text_col}`").cast("binary"))
    joined = docs.join(spans, (docs[id_col].cast("long") == spans["__id"]) & (hashed == spans["__hash"]), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.schema.get_field_index(text_col)
            texts = batch.column(column).to_pylist()
            keep = np.ones(batch.num_rows, bool)
            for i, spans_of in enumerate(batch.column("__spans")):
                spans_of = spans_of.as_py()
                if spans_of:
                    ends = [(0, 0), *(m.span() for m in _WORD.finditer(texts[i]))]
                    out, now = [], 0
                    for span in spans_of:
                        out.append(texts[i][now : ends[span["start_word"]][1]])
                        now = ends[span["start_word"] + span["n_words"]][1]
                    texts[i] = "".join([*out, texts[i][now:]])
                    keep[i] = _WORD.search(texts[i]) is not None
            columns = [pa.array(texts, pa.string()) if k == column else c for k, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1]).filter(pa.array(keep))

    return batches_of(joined.drop("__id", "__hash"), run, docs.schema)
