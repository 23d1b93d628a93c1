"""Spelling variants: exact neighbours of words by a dictionary of trie-node pairs.

Every word is a path in a trie and, read backwards, a path in a second one. Their
nodes are numbered, so that a word split at a position is a pair of integers
(prefix node, suffix node), and so is a word with the code point at a position
skipped. Two words differ by one replaced code point exactly where two skipped
pairs are equal, and by one inserted or deleted code point exactly where a
skipped pair equals a split one. A pair names one prefix and one suffix, so it
meets at most one word per code point of the alphabet and one without it.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerloom.llm.common import batches_of, rows_of
from careerloom.runtime import cut

#: Runs of A-Z, a-z and the code points C0 to FF, in UTF-8.
RUN = re.compile(rb"(?:[A-Za-z]|\xC3[\x80-\xBF])+")

#: Nodes this near to a root are at most 1 + 90 + 90 * 90 for the 90 code points of lower-cased runs.
NEAR_ROOT = 2

#: Sides that grow with the vocabulary: compressed files and exploded rows look small enough to broadcast and are not.
MERGE = "merge"


def without(run: bytes, h: int) -> bytes:
    """``run`` without its code point ``h`` modulo length."""
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def _runs(text: bytes, long: int = 8 << 20) -> Counter:
    """How often a text has each run; only A-Z are lower-cased. A very long text is not held as a list of runs."""
    text = text.lower()
    return Counter(RUN.findall(text) if len(text) < long else (m.group() for m in RUN.finditer(text)))


def word_counts(docs: DataFrame, length: int, least: int, damage: int, id_col: str, text_col: str, held: int = 200_000) -> DataFrame:
    """``word, n``: the words of at least ``length`` code points that occur at least ``least`` times.

    A run loses a code point where ``damage`` divides the crc32 of its document's id and itself. Tasks add up what
    they hold before anything is shuffled.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for i, text in enumerate(batch.column("text")):
                seed = zlib.crc32(b"" if ids[i] is None else str(ids[i]).encode())
                seed = zlib.crc32(b":", seed)
                for run, n in _runs(text.as_py()).items():
                    if len(run) < length:
                        continue
                    h = zlib.crc32(run, seed)
                    if h % damage == 0:
                        run = without(run, h)
                    # The lead byte C3 comes once for each code point of two bytes.
                    if len(run) - run.count(b"\xc3") >= length:
                        counts[run] += n
                if len(counts) >= held:
                    yield _counted(counts)
                    counts.clear()
        if counts:
            yield _counted(counts)

    rows = rows_of(docs, id_col, text_col).select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text")
    )
    found = batches_of(rows.filter("text is not null"), scan, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _counted(counts: Counter) -> pa.RecordBatch:
    words = pa.array([w.decode() for w in counts], pa.string())
    return pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], names=["word", "n"])


def _nodes(text: str, short: int = 32) -> list[bytes]:
    """What tells the nodes on the path of ``text`` apart: the path itself, or its SHA-256 where that is shorter."""
    out, path, sha = [b""], b"", hashlib.sha256()
    for c in text:
        c = c.encode()
        sha.update(c)
        if len(path) <= short:
            path += c
        # 33 bytes, so never equal to a path of at most 32.
        out.append(path if len(path) <= short else b"#" + sha.copy().digest())
    return out


def _paths(words: DataFrame) -> DataFrame:
    """``id, at, part, depth, node, first``: the node before, at and behind every position of a word.

    Part 0 is the prefix before position ``at``, part 1 the suffix from it, part 2 the suffix behind it. ``first``:
    the code point there differs from the one before it, so that equal neighbours are skipped once only.
    """
    schema = "id long, at int, part byte, depth int, node binary, first boolean"
    names = ["id", "at", "part", "depth", "node", "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for id_, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist()):
                size = len(word)
                for at, node in enumerate(_nodes(word)):
                    out.append((id_, at, 0, at, node, at == 0 or at < size and word[at] != word[at - 1]))
                for back, node in enumerate(_nodes(word[::-1])):
                    out.append((id_, size - back, 1, back, node, None))
                    if back < size:
                        out.append((id_, size - back - 1, 2, back, node, None))
                if len(out) >= 50_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int8(), pa.int32(), pa.binary(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return batches_of(words.select("id", "word"), run, schema)


def _numbered(paths: DataFrame) -> DataFrame:
    """``id, at, prefix, suffix, behind, first``: paths with the numbers of their nodes.

    Nodes near a root lie on the paths of very many words; there is a fixed bound to their number, so they are broadcast.
    Nothing else of the vocabulary's size is: the optimiser takes the paths of a word for one row.
    """
    side = (F.col("part") > 0).alias("side")
    paths = paths.select("id", "at", "part", side, "depth", "node", "first")
    # Written: a lost executor must not number the nodes anew.
    nodes = cut(paths.select("side", "depth", "node").distinct().withColumn("number", F.monotonically_increasing_id()))
    near, far = F.col("depth") <= NEAR_ROOT, F.col("depth") > NEAR_ROOT
    on = ["side", "depth", "node"]
    placed = paths.filter(near).join(F.broadcast(nodes.filter(near)), on).unionByName(paths.filter(far).join(nodes.filter(far).hint(MERGE), on))
    part = lambda k: F.max(F.when(F.col("part") == k, F.col("number")))
    return placed.groupBy("id", "at").agg(
        part(0).alias("prefix"), part(1).alias("suffix"), part(2).alias("behind"), F.max("first").alias("first")
    )


def _neighbours(words: DataFrame) -> DataFrame:
    """``id, n_near, best``: how many near words a word has, and the most frequent one as ``(n, -id)``.

    Ids follow the order of the words, so of equal counts the smallest word has the largest ``-id``.
    """
    rank = F.struct("n", (-F.col("id")).alias("o"))
    places = _numbered(_paths(words)).join(words.select("id", "n").hint(MERGE), "id")
    pairs = places.select(
        "prefix",
        F.explode(
            F.array(
                F.struct(F.col("suffix").alias("node"), F.lit(True).alias("whole"), F.lit(False).alias("first"), rank.alias("rank")),
                F.struct(F.col("behind").alias("node"), F.lit(False).alias("whole"), F.col("first").alias("first"), rank.alias("rank")),
            )
        ).alias("pair"),
    ).select("prefix", "pair.*")
    # At most one word per code point of the alphabet and one whole word.
    met = pairs.filter("node is not null").groupBy("prefix", "node").agg(F.collect_list(F.struct("whole", "first", "rank")).alias("m")).filter(F.size("m") > 1)
    met = met.select(
        F.get(F.filter("m", lambda x: x.whole), F.lit(0))["rank"].alias("whole"),
        F.sort_array(F.transform(F.filter("m", lambda x: ~x.whole), lambda x: F.struct(x.rank.alias("rank"), x.first.alias("first"))), asc=False).alias("skips"),
    )
    ranks = F.transform("skips", lambda x: x.rank)
    firsts = F.transform(F.filter("skips", lambda x: x.first), lambda x: x.rank)
    met = met.select("whole", "skips", ranks.alias("ranks"), firsts.alias("firsts"))

    def of_skip(x: Column) -> Column:
        longer = x.first & F.col("whole").isNotNull()
        other = F.when(x.rank == F.get("ranks", F.lit(0)), F.get("ranks", F.lit(1))).otherwise(F.get("ranks", F.lit(0)))
        return F.struct(
            (-x.rank.o).alias("id"),
            (F.size("ranks") - 1 + longer.cast("int")).cast("long").alias("n"),
            F.greatest(other, F.when(longer, F.col("whole"))).alias("best"),
        )

    of_whole = F.struct((-F.col("whole.o")).alias("id"), F.size("firsts").cast("long").alias("n"), F.get("firsts", F.lit(0)).alias("best"))
    told = F.concat(F.transform("skips", of_skip), F.array(of_whole))
    told = met.select(F.explode(told).alias("t")).select("t.*").filter("id is not null and n > 0")
    return told.groupBy("id").agg(F.sum("n").alias("n_near"), F.max("best").alias("best"))


def spelling_variants(
    docs: DataFrame,
    length: int = 6,
    least: int = 5,
    times: int = 5,
    damage: int = 199,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: the words of a corpus, each with the spelling it is a variant of.

    Words are runs of letters as ``word_counts`` takes them. A word's form is
    its most frequent near word (ties: the smallest in code-point order), if
    that occurs at least ``times`` as often; its root is where the forms lead,
    itself if it has none. Null texts have no words, a null id counts as an
    empty one, rows that repeat count again. No words give no rows.
    """
    counted = cut(word_counts(docs, length, least, damage, id_col, text_col))
    words = cut(counted.orderBy("word").withColumn("id", F.monotonically_increasing_id()))
    told = _neighbours(words)
    linked = words.join(told.hint(MERGE), "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "best")
    is_form = F.col("best.n") >= F.col("n") * times
    linked = cut(linked.withColumn("form_id", F.when(is_form, -F.col("best.o"))).withColumn("form_n", F.when(is_form, F.col("best.n"))).drop("best"))
    roots = cut(linked.filter("form_id is not null").select("id", F.col("form_id").alias("to")))
    most = words.agg(F.max("n")).first()[0]
    # Counts grow by ``times`` with each step, so the longest way has a known bound; every round doubles what is covered.
    steps = math.log(most / least, times) if most else 0
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        further = roots.select(F.col("id").alias("to"), F.col("to").alias("next"))
        roots = cut(roots.join(further.hint(MERGE), "to", "left").select("id", F.coalesce("next", "to").alias("to")))
    names = words.select("id", "word")
    form, root = names.select(F.col("id").alias("form_id"), F.col("word").alias("form")), names.select(F.col("id").alias("to"), F.col("word").alias("root"))
    return (
        linked.join(form.hint(MERGE), "form_id", "left")
        .join(roots.join(root.hint(MERGE), "to").select("id", "root").hint(MERGE), "id", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    )
