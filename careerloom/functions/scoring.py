"""Similarity and score functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql import functions as F

from careerloom.functions.text import _c, strip


def _codes(texts: list[str], width: int) -> np.ndarray:
    """Code points, one text per row, padded with zeros."""
    out = np.zeros((len(texts), width), np.uint32)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def common_lengths(a: list[str], b: list[str], step: int = 4096) -> np.ndarray:
    """Length of the longest common subsequence of every pair, a whole batch at a time.

    The positions of ``a`` are the bits of a word; per position of ``b`` one addition moves all matches of all pairs
    forward at once. Where ``a`` has more than 63 characters the words are Python's long integers.
    """
    out = np.zeros(len(a), np.int64)
    short = np.array([len(x) <= 63 for x in a], bool)
    for s in range(0, len(a), step):
        rows = np.flatnonzero(short[s : s + step]) + s
        if not len(rows):
            continue
        xs, ys = [a[i] for i in rows], [b[i] for i in rows]
        x, y = _codes(xs, max(1, max(map(len, xs)))), _codes(ys, max(map(len, ys), default=0))
        bits = np.uint64(1) << np.arange(x.shape[1], dtype=np.uint64)
        rest = np.full(len(rows), ~np.uint64(0))
        for j in range(y.shape[1]):
            match = ((x == y[:, [j]]) & (y[:, [j]] > 0)) @ bits
            hit = rest & match
            rest = (rest + hit) | (rest & ~match)
        length = np.array([len(t) for t in xs], np.uint64)
        used = ~rest & ((np.uint64(1) << length) - np.uint64(1))
        out[rows] = np.bitwise_count(used)
    for i in np.flatnonzero(~short):
        places: dict[str, int] = {}
        for k, c in enumerate(a[i]):
            places[c] = places.get(c, 0) | 1 << k
        full = (1 << len(a[i])) - 1
        rest = full
        for c in b[i]:
            match = places.get(c, 0)
            hit = rest & match
            rest = ((rest + hit) | (rest & ~match)) & full
        out[i] = (~rest & full).bit_count()
    return out


@F.pandas_udf(T.LongType())
def _common_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(common_lengths(a.tolist(), b.tolist()))


def title_similarity(a: Column | str, b: Column | str) -> Column:
    """Share of two titles that is a common subsequence, case and outer blanks ignored: ``2 * common / (both lengths)``.

    Equal titles are settled in the JVM. Never less than the share that lies in
    matching blocks, and symmetric, which that is not.
    """
    x = F.lower(strip(F.coalesce(_c(a), F.lit(""))))
    y = F.lower(strip(F.coalesce(_c(b), F.lit(""))))
    same = x == y
    # Python gets empty texts for settled pairs, which cost nothing there.
    common = _common_length(F.when(same, F.lit("")).otherwise(x), F.when(same, F.lit("")).otherwise(y))
    return F.when(same, F.lit(1.0)).otherwise(2.0 * common / (F.length(x) + F.length(y)))


def edit_similarity(a: Column | str, b: Column | str) -> Column:
    """``1 - levenshtein / longer length``; runs in the JVM."""
    x = F.lower(strip(F.coalesce(_c(a), F.lit(""))))
    y = F.lower(strip(F.coalesce(_c(b), F.lit(""))))
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(x, y) / longest)


def taxonomy_match_score(label: Column | str, title: Column | str) -> Column:
    """3 prefix, 2 substring, 1 same first word, else 0; labels under two characters get 0."""
    lab, tit = F.lower(_c(label)), F.lower(_c(title))
    first = lambda c: F.split(strip(c), r"\s+").getItem(0)
    return (
        F.when(lab.isNull() | (F.length(lab) < 2), F.lit(0))
        .when(tit.startswith(lab), F.lit(3))
        .when(tit.contains(lab), F.lit(2))
        .when((first(lab) != "") & (first(lab) == first(tit)), F.lit(1))
        .otherwise(F.lit(0))
    )


def is_circular_broader(label: Column | str, broader: Column | str, limit: float = 0.6) -> Column:
    """True where the broader label is made of mostly the label's own words."""
    words = lambda c: F.array_distinct(
        F.filter(F.split(F.lower(_c(c)), r"\s+"), lambda w: w != "")
    )
    a, b = words(label), words(broader)
    longest = F.greatest(F.size(a), F.size(b))
    share = F.size(F.array_intersect(a, b)) / longest
    return F.coalesce((F.size(a) > 0) & (F.size(b) > 0) & (share >= limit), F.lit(False))


def ratio(num: Column | str, den: Column | str, empty: float = 0.0) -> Column:
    num, den = _c(num), _c(den)
    return F.when(den > 0, num / den).otherwise(F.lit(empty))


def prf(matched: Column | str, extracted: Column | str, expected: Column | str, digits: int = 6) -> list[Column]:
    """precision, recall and f1, zero on empty denominators, half-even rounding."""
    p, r = ratio(matched, extracted), ratio(matched, expected)
    f1 = ratio(F.lit(2.0) * p * r, p + r)
    return [
        F.bround(p, digits).alias("precision"),
        F.bround(r, digits).alias("recall"),
        F.bround(f1, digits).alias("f1"),
    ]
