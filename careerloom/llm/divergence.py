"""Which terms and which other sources a source differs by: dominance skybands, then exact ranks.

A source over-uses a term by p - q, its own share less its language's. The share
p grows with the term's count in the source and q with the one in the language,
so a term is surely no better than another one that has at least its count in
the source, at most its count in the language, and comes earlier in UTF-8. Every
partition keeps the terms that fewer than ``top`` others dominate so; these
skybands are merged, and only what is left is ranked by the exact values.
Dominance is transitive: a term dropped anywhere has ``top`` better ones that stay.

Sources are compared pairwise by the sum of abs(p - q) over all kept terms, in
units of some terms and two blocks of sources, as rows of a small matrix.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careerloom.llm.common import batches_of, rows_of
from careerloom.runtime import broadcast_if_small, cut

#: Runs of letters and of all code points from 80 on. In UTF-8 these have no byte below 80, so bytes may be searched.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str, held: int = 200_000, long: int = 8 << 20) -> DataFrame:
    """``lang, source, term, n, n_docs``: occurrences and documents; a row with a null term for every group there is.

    Tasks add up what they hold before anything is shuffled.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for i, text in enumerate(batch.column("text")):
                n, n_docs = groups.setdefault((langs[i], sources[i]), (Counter(), Counter()))
                text, before = text.as_py().lower(), len(n)
                found = Counter(TERM.findall(text) if len(text) < long else (m.group() for m in TERM.finditer(text)))
                n.update(found)
                n_docs.update(found.keys())
                size += len(n) - before
                if size >= held:
                    yield from _counted(groups)
                    groups, size = {}, 0
        yield from _counted(groups)

    text, lang, source = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (text_col, lang_col, source_col))
    rows = rows_of(docs, text_col, lang_col, source_col).select(text.cast("binary").alias("text"), lang.alias("lang"), source.alias("source"))
    found = batches_of(rows, scan, "lang string, source string, term string, n long, n_docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def _counted(groups: dict[tuple, tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, n_docs) in groups.items():
        terms = [None, *(t.decode() for t in n)]
        columns = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.string())]
        columns += [pa.array([0, *n.values()], pa.int64()), pa.array([0, *(n_docs[t] for t in n)], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "n_docs"])


def _share(n: Column | str, total: str, kept: str, smoothing: int, scale: int) -> Column:
    """1 + floor(scale * (n + smoothing) / (total + smoothing * kept)), exact for any counts."""
    whole = lambda c: f"cast({c} as decimal(19, 0))"
    return F.expr(f"1 + ({whole(scale)} * {whole(f'{n} + {smoothing}')}) div {whole(f'{total} + {smoothing} * {kept}')}")


class _Band:
    """The skyband of one group so far; terms come in the order of their UTF-8."""

    def __init__(self, top: int):
        self.top, self.size = top, 0
        self.n, self.total = np.empty(1024, np.int64), np.empty(1024, np.int64)

    def keep(self, n: np.ndarray, total: np.ndarray, step: int = 256) -> np.ndarray:
        """Which of the next terms fewer than ``top`` earlier ones dominate."""
        out = []
        for s in range(0, len(n), step):
            a, b = n[s : s + step], total[s : s + step]
            # Dominators among the terms kept before and among the earlier ones of this step.
            before = ((self.n[: self.size] >= a[:, None]) & (self.total[: self.size] <= b[:, None])).sum(1)
            here = np.tril((a >= a[:, None]) & (b <= b[:, None]), -1).sum(1)
            kept = before + here < self.top
            self._add(a[kept], b[kept])
            out.append(kept)
        return np.concatenate(out)

    def _add(self, n: np.ndarray, total: np.ndarray) -> None:
        end = self.size + len(n)
        if end > len(self.n):
            self.n, self.total = (np.concatenate([x, np.empty(end, np.int64)]) for x in (self.n, self.total))
        self.n[self.size : end], self.total[self.size : end] = n, total
        self.size = end


def _skyband(rows: DataFrame, key: list[str], top: int) -> DataFrame:
    """Of rows sorted by ``key`` and term within their partitions, those in the skyband of their key there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, band = None, _Band(top)
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in key)))
            n, total = batch.column("n").to_numpy(), batch.column("total").to_numpy()
            edges = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
            kept = [np.empty(0, bool)]
            for s, e in zip(edges, edges[1:]):
                if keys[s] != now:
                    now, band = keys[s], _Band(top)
                kept.append(band.keep(n[s:e], total[s:e]))
            yield batch.filter(pa.array(np.concatenate(kept)))

    return batches_of(rows.sortWithinPartitions(*key, "term"), run, rows.schema)


def skyband(rows: DataFrame, key: list[str], top: int, part_rows: int = 50_000) -> DataFrame:
    """The rows of each ``key`` that fewer than ``top`` others dominate (``n`` as large, ``total`` as small, ``term`` earlier), and perhaps some more.

    First within the partitions as they lie, then within parts of about
    ``part_rows`` of what is left of a key, again and again until a key is one
    part or parts lose less than a tenth: a key's rows never meet in one task
    unless they are few.
    """
    band = cut(_skyband(rows, key, top))
    left = band.count()
    while left:
        parts = band.groupBy(*key).agg(F.ceil(F.count("*") / part_rows).alias("__parts"))
        dealt = band.join(parts, key).withColumn("__part", F.pmod(F.xxhash64("term"), F.col("__parts")))
        dealt = dealt.drop("__parts").repartition(*key, "__part")
        most, before = parts.agg(F.max("__parts")).first()[0], left
        band = cut(_skyband(dealt, [*key, "__part"], top).drop("__part"))
        left = band.count()
        if most == 1 or left > 0.9 * before:
            break
    return band


def _distances(kept: DataFrame, groups: DataFrame, block: int, unit_rows: int) -> DataFrame:
    """``lang, a, b, far, seen``: for sources a and b of a language the sum of abs(p - q) over the ``seen`` terms that a unit holds.

    ``kept`` has ``lang, no, term, p``; ``groups`` has ``lang, no, p0``: the share of a term that the source does not have.
    """
    sizes = kept.groupBy("lang").agg(F.count("*").alias("rows"))
    spread = groups.groupBy("lang").agg(F.max("no").alias("last")).join(sizes, "lang", "left")
    spread = spread.select(
        "lang", F.ceil(F.coalesce("rows", F.lit(1)) / unit_rows).alias("chunks"), (F.col("last") / block).cast("long").alias("blocks")
    )
    # Written first, so that its size is known: one row per language.
    spread = broadcast_if_small(cut(spread))
    mine = (F.col("no") / block).cast("long")
    terms = kept.join(spread, "lang").select("lang", "no", "term", "p", F.pmod(F.xxhash64("term"), F.col("chunks")).alias("chunk"), "blocks")
    # Every unit gets the sources of its blocks, whether it has terms of theirs or not.
    heads = groups.join(spread, "lang").select(
        "lang", "no", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "blocks",
    )
    units = terms.unionByName(heads).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks"))))
    units = units.select("lang", "chunk", F.least(mine, "other").alias("x"), F.greatest(mine, "other").alias("y"), "no", "term", "p")

    cells = 2 << 20

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lang, _, x, y = key
        head = rows[rows["term"].isna()].sort_values("no")
        nos, p0 = head["no"].to_numpy(), head["p"].to_numpy()
        rows = rows[rows["term"].notna()]
        code = pd.factorize(rows["term"])[0]
        order = np.argsort(code, kind="stable")
        code, at, p = code[order], np.searchsorted(nos, rows["no"].to_numpy())[order], rows["p"].to_numpy()[order]
        left, right = np.flatnonzero(nos // block == x), np.flatnonzero(nos // block == y)
        far = np.zeros((len(left), len(right)), np.int64)
        seen = int(code[-1]) + 1 if len(code) else 0
        step = max(1, cells // max(1, len(nos)))
        for first in range(0, seen, step):
            s, e = np.searchsorted(code, [first, first + step])
            table = np.tile(p0, (min(step, seen - first), 1))
            table[code[s:e] - first, at[s:e]] = p[s:e]
            for i, k in enumerate(left):
                far[i] += np.abs(table[:, right] - table[:, [k]]).sum(0)
        a, b = np.repeat(nos[left], len(right)), np.tile(nos[right], len(left))
        out = pd.DataFrame({"a": a, "b": b, "far": far.ravel()})
        if x != y:
            out = pd.concat([out, out.rename(columns={"a": "b", "b": "a"})])
        out = out[out["a"] != out["b"]]
        return out.assign(lang=lang, seen=seen)[["lang", "a", "b", "far", "seen"]]

    return units.groupBy("lang", "chunk", "x", "y").applyInPandas(compare, "lang string, a long, b long, far long, seen long")


def source_divergence(
    docs: DataFrame,
    min_docs: int = 30,
    top: int = 50,
    smoothing: int = 5,
    scale: int = 10**9,
    block: int = 128,
    unit_rows: int = 100_000,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every language and source that occur.

    Terms are runs of letters with A-Z in lower case; a language keeps those of
    at least ``min_docs`` of its documents (rows). A count c is a share
    ``1 + floor(scale * (c + smoothing) / (N + smoothing * V))``, N the sum of
    counts over the V kept terms. Part ``pair`` ranks all other sources of the
    language by the sum of the differences of shares over all kept terms, 0 if
    there are none; part ``term`` the first ``top`` kept terms that the source
    has and uses more than its language. Larger values rank first, ties by
    UTF-8. Null texts, languages and sources count as empty ones; rows that
    repeat count again; no rows give no rows.
    """
    counts = cut(term_counts(docs, text_col, lang_col, source_col))
    terms = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("n_docs").alias("n_docs"))
    terms = cut(terms.filter(F.col("n_docs") >= min_docs).select("lang", "term", "total"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    found = cut(counts.filter("term is not null").select("lang", "source", "term", "n").join(terms, ["lang", "term"]))
    # One row per group: what a table of sources holds.
    groups = counts.filter("term is null").select("lang", "source").join(langs, "lang", "left")
    groups = groups.join(found.groupBy("lang", "source").agg(F.sum("n").alias("group_n")), ["lang", "source"], "left")
    no = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = cut(groups.fillna(0, ["v", "lang_n", "group_n"]).withColumn("no", no.cast("long")))

    shared = found.join(broadcast_if_small(groups), ["lang", "source"])
    p, q = _share("n", "group_n", "v", smoothing, scale), _share("total", "lang_n", "v", smoothing, scale)
    shared = shared.select("lang", "source", "no", "term", "n", "total", p.alias("p"), q.alias("q"))

    more = shared.filter("p > q").select("lang", "source", "term", "n", "total", (F.col("p") - F.col("q")).alias("value"))
    best = skyband(more, ["lang", "source"], top)
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = best.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    ranked = ranked.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)

    none = F.when(F.col("v") > 0, _share("0", "group_n", "greatest(v, 1)", smoothing, scale)).otherwise(0)
    heads = groups.select("lang", "no", "source", "v", none.cast("long").alias("p0"))
    far = _distances(shared.select("lang", "no", "term", "p"), heads.select("lang", "no", "p0"), block, unit_rows)
    far = far.groupBy("lang", "a", "b").agg(F.sum("far").alias("far"), F.sum("seen").alias("seen"))
    here = heads.select("lang", F.col("no").alias("a"), "source", "v", "p0")
    there = heads.select("lang", F.col("no").alias("b"), F.col("source").alias("item"), F.col("p0").alias("p0_b"))
    pairs = far.join(broadcast_if_small(here), ["lang", "a"]).join(broadcast_if_small(there), ["lang", "b"])
    # Terms that neither source has in the units that hold them.
    value = F.col("far") + (F.col("v") - F.col("seen")) * F.abs(F.col("p0") - F.col("p0_b"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", F.row_number().over(by_value))
    return pairs.unionByName(ranked)
