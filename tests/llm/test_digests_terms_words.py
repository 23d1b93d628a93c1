"""Exact dedup, source divergence and spelling variants against plain versions, with the odd cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from careerloom.llm import digests, divergence, variants
from careerloom.runtime import cut

ODD = [
    (1, "Same text", "de", "a"),
    (2, "Same text", "de", "b"),
    (3, "same text", "de", None),
    (4, None, "de", "a"),
    (5, "", None, None),
    (6, " ", "", ""),
    (7, "Same text", "fr", "a"),
    (7, "Same text", "fr", "a"),
    (7, "another text with the same id", "fr", "b"),
    (None, "Same text", "fr", "c"),
    (None, "a row without an id", "fr", "c"),
    (None, "a row without an id", None, "c"),
    (8, "Élan élan ÉLAN naïveté straße × ÷ 東京 " * 2000, "fr", "c"),
    (9, "x" * 200_000, "fr", "c"),
]
CLASHES = ", digest binary, keep_id long, n long, term string, word string, id long, part int, no long, value double, side int"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, b"d", 1, 2, "t", "w", 3, 4, 5, 0.5, 6) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string" + CLASHES).repartition(3)


@pytest.fixture(scope="module")
def prose(spark):
    """Random words with spelling variants, over two languages with four sources, one of them with most rows."""
    rng = random.Random(5)
    stems = ["".join(rng.choices("abcdeéßÿ", k=rng.randint(6, 9))) for _ in range(25)]

    def word():
        w = rng.choice(stems)
        if rng.random() < 0.3:
            at, c = rng.randrange(len(w)), rng.choice("abé")
            w = rng.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]])
        return w.upper() if rng.random() < 0.1 else w

    rows = []
    for i in range(400):
        source = "hot" if i % 2 else f"s{i % 3}"
        rows.append((i, " ".join(word() for _ in range(rng.randint(0, 80))) + rng.choice([".", " x9 東京", "\x00\x7f"]), "ab"[i % 5 == 0], source))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)


# --- exact dedup


def plain_groups(rows):
    groups = collections.defaultdict(list)
    for i, text, *_ in rows:
        groups[text or ""].append(i)
    out = []
    for i, text, *_ in rows:
        ids = groups[text or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("loads", [1, 2, 5])
def test_exact_duplicates_equal_plain_groups(spark, odd, loads):
    got = digests.exact_duplicates(odd, digests.DigestIndex.scratch(spark, 4), loads=loads)
    assert sorted(map(tuple, got.collect()), key=str) == plain_groups(ODD)


def test_exact_duplicates_of_nothing(spark, odd):
    index = digests.DigestIndex.scratch(spark, 2)
    assert digests.exact_duplicates(odd.limit(0), index).count() == 0
    assert digests.exact_duplicates(odd.filter("doc_id is null"), index).count() == 3


def test_a_heavy_group_and_light_ones(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") / 2).cast("long"))).alias("text"))
    got = digests.exact_duplicates(docs, digests.DigestIndex.scratch(spark, 2)).collect()
    want = plain_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, got), key=str) == want


def test_the_index_outlives_the_session_catalog_and_knows_its_texts(spark, odd):
    index = digests.DigestIndex.scratch(spark, 3)
    first = digests.new_documents(odd.filter("doc_id <= 3"), index)
    assert sorted(r.doc_id for r in first.collect()) == [2, 3]
    assert first.columns == odd.columns
    spark.sql(f"DROP TABLE {index.table}")  # the files stay: the table is external
    again = digests.DigestIndex(spark, index.path, buckets=99)
    assert again.buckets == 3 and again.entries().count() == 2
    # Known texts are not new, a load that is taken in twice adds nothing.
    assert sorted(str(r.doc_id) for r in digests.new_documents(odd, again).collect()) == ["5", "6", "7", "8", "9", "None"]
    assert digests.new_documents(odd, again).count() == 0
    before = again.entries().count()
    again.compact()
    assert again.entries().count() == before
    third = digests.DigestIndex(spark, index.path)
    assert third.generation == 1 and third.entries().count() == before
    # The id that the index holds stays, whatever comes later.
    kept = {r.text_sha256: r.keep_id for r in digests.exact_duplicates(odd, third).collect()}
    assert kept[hashlib.sha256(b"Same text").hexdigest()] == 2


def test_the_index_is_joined_where_it_lies(spark, odd):
    index = digests.DigestIndex.scratch(spark, 4)
    load = odd.select("doc_id", digests.digest_of("text").alias("digest"))
    index.append(load)
    plan = index.unknown(load)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert plan.count("Exchange") == 1  # the load's side


# --- source divergence


def plain_divergence(rows, min_docs, top):
    rows = [(text or "", lang or "", source or "") for _, text, lang, source in rows]
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    found = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(lower)) for text, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        df = collections.Counter(t for r, f in zip(rows, found) if r[1] == lang for t in set(f))
        kept = {t for t, n in df.items() if n >= min_docs}
        count = collections.defaultdict(collections.Counter)
        for r, f in zip(rows, found):
            if r[1] == lang:
                for key in (r[2], None):
                    count[key].update(t for t in f if t in kept)
        share = {
            s: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept} for s, c in count.items()
        }
        for s in count:
            if s is None:
                continue
            pairs = [(sum(abs(share[s][t] - share[o][t]) for t in kept), o) for o in count if o not in (s, None)]
            terms = [(share[s][t] - share[None][t], t) for t in kept if count[s][t] and share[s][t] > share[None][t]]
            order = lambda x: (-x[0], x[1].encode())
            out += [(lang, s, "pair", o, v, i + 1) for i, (v, o) in enumerate(sorted(pairs, key=order))]
            out += [(lang, s, "term", t, v, i + 1) for i, (v, t) in enumerate(sorted(terms, key=order)[:top])]
    return sorted(out)


@pytest.mark.parametrize("min_docs, top, block, unit_rows", [(3, 50, 128, 100_000), (2, 3, 2, 400), (400, 5, 2, 50)])
def test_divergence_equals_plain_version(prose, min_docs, top, block, unit_rows):
    got = divergence.source_divergence(prose, min_docs=min_docs, top=top, block=block, unit_rows=unit_rows)
    want = plain_divergence([tuple(r) for r in prose.collect()], min_docs, top)
    assert sorted(map(tuple, got.collect())) == want


def test_divergence_of_odd_rows(odd):
    for min_docs in (1, 2):
        got = divergence.source_divergence(odd, min_docs=min_docs, top=2)
        assert sorted(map(tuple, got.collect())) == plain_divergence(ODD, min_docs, 2)
    assert divergence.source_divergence(odd.limit(0)).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    n, total, kept = 7 * 10**15 + 1, 10**17 + 3, 10**6 + 7
    frame = spark.createDataFrame([(n, total, kept)], "n long, total long, v long")
    got = frame.select(divergence._share("n", "total", "v", 5, 10**9).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * kept)


def test_a_skyband_holds_all_the_best_and_sheds_rows(spark):
    rng = np.random.default_rng(3)
    rows = [("g", f"{i:05d}", int(a), int(a + b)) for i, (a, b) in enumerate(zip(rng.zipf(1.5, 4000) % 1000, rng.zipf(1.3, 4000) % 1000))]
    frame = spark.createDataFrame(rows, "key string, term string, n long, total long").repartition(6)
    got = {r.term for r in divergence.skyband(frame, ["key"], 10, part_rows=300).collect()}
    better = lambda a, b: a[2] >= b[2] and a[3] <= b[3] and a[1] < b[1]
    for row in rows:
        if row[1] not in got:
            assert sum(better(x, row) for x in rows) >= 10
    assert len(got) < 2500
    one_part = {r.term for r in divergence.skyband(frame, ["key"], 10).collect()}
    assert one_part == {r[1] for r in rows if sum(better(x, r) for x in rows) < 10}


# --- spelling variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, length=6, least=5, damage=199):
    count = collections.Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % damage == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= length and n >= least}
    form, n_near = {}, {}
    for w, n in words.items():
        others = [o for o in words if near(w, o)]
        n_near[w] = len(others)
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, n_near[w], words.get(form[w])))
    return sorted(out, key=str)


@pytest.mark.parametrize("length, least, damage", [(6, 5, 199), (3, 2, 5), (1, 1, 2)])
def test_variants_equal_plain_version(prose, length, least, damage):
    got = variants.spelling_variants(prose, length=length, least=least, damage=damage).collect()
    want = plain_variants([tuple(r) for r in prose.collect()], length, least, damage)
    assert sorted(map(tuple, got), key=str) == want
    assert any(r.form for r in got) and any(r.root != (r.form or r.word) for r in got)


def test_variants_of_odd_rows(odd):
    got = variants.spelling_variants(odd, length=1, least=1)
    assert sorted(map(tuple, got.collect()), key=str) == plain_variants(ODD, 1, 1)
    assert variants.spelling_variants(odd.limit(0)).count() == 0
    assert variants.spelling_variants(odd.filter("text is null")).count() == 0


def test_repeated_letters_and_very_long_words(spark):
    long = "ab" * 3000
    texts = [(1, " ".join(["aaaaaa", "aaaaaaa", "aaaaaaaa", "aabaaa", long, long + "b", long[:999] + "c" + long[1000:]] * 5))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = variants.spelling_variants(docs, damage=1 << 40).collect()
    assert sorted(map(tuple, got), key=str) == plain_variants(texts, damage=1 << 40)


def test_roots_at_the_end_of_a_long_way(spark):
    words = ["".join("b" if j < i else "a" for j in range(9)) for i in range(6)]
    text = " ".join(w for i, w in enumerate(words) for _ in range(5 * 5**i))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {r.word: r.root for r in variants.spelling_variants(docs, damage=1 << 40).collect()}
    assert got == {w: words[-1] for w in words}


def test_only_nodes_near_a_root_are_broadcast(spark):
    """The optimiser takes the paths of a word for one row, and then sends all of them to the driver."""
    words = spark.range(100).select("id", F.concat(F.lit("word"), F.col("id").cast("string")).alias("word"), F.lit(5).cast("long").alias("n"))
    told = variants._neighbours(cut(words))
    assert str(told._jdf.queryExecution().sparkPlan()).count("BroadcastHashJoin") == 1
