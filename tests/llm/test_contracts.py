"""Small sources, large components, several texts of an id: cases at the edge of what the operators promise."""

import collections
import random

import numpy as np
import pytest

from careerloom.llm import common, mixing, simhash, topk


def test_small_sources_meet_their_targets_to_the_word(spark):
    rows, n = [], 0
    for size in (1, 2, 5, 10, 31, 32, 33, 40, 63, 64, 65):
        rows += [(n, " ".join(["w"] * size), f"s{n:02d}")]
        n += 1
    rows += [(n + i, " ".join(["v"] * 50), "zz") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    taken, target, size = collections.Counter(), {}, {}
    source_of = {i: s for i, _, s in rows}
    for x in got:
        s = source_of[x["doc_id"]]
        taken[s] += x["taken"]
        target[s], size[s] = x["target"], x["source_size"]
        assert x["taken"] <= 3 * x["size"]
    for s in target:
        assert abs(taken[s] - target[s]) <= (0.5 if size[s] <= 64 else 64.5), s
    assert taken["s03"] == 30  # ten words, three times


def test_mixed_documents_take_clashing_names(spark):
    names = ["row", "pieces", "mixed", "sid", "uses", "first", "words", "blk"]
    docs = spark.createDataFrame(
        [(i, "a b c d e f g", "s", *[f"{c}{i}" for c in names]) for i in range(5)], f"doc_id long, text string, source string, {', '.join(f'{c} string' for c in names)}"
    )
    got = mixing.mixed_documents(docs).collect()
    assert got and all(x[c] == f"{c}{x['doc_id']}" for x in got for c in names)
    assert mixing.mix(docs).count() == 5


@pytest.mark.parametrize("most", [100, 10**5, 10**9, 10**25])
def test_products_are_exact_whatever_the_components(spark, most):
    r = np.random.default_rng(8)
    rows = [(i, (r.random(8 + 4 * (i % 3)) * 2 - 1) * most) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(9)] + [(400 + i, np.zeros(8)) for i in range(20)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.filter("vec_id % 100 = 0"), k=5, tile=16, query_tile=2, fan_in=3, tiles_per_task=2).collect()
    whole = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows]
    want = []
    for q, u in whole:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(u, v)), i) for i, v in whole if i != q and len(v) == len(u))[:5]
            want += [(q, n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(best)]
    assert sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in got) == sorted(want)


def test_every_text_of_an_id_has_its_own_fate(spark):
    r = random.Random(2)
    a, b = (" ".join("w%d" % r.randrange(10**6) for _ in range(60)) for _ in range(2))
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (7, a + " more"), (None, a), (9, None)], "doc_id long, text string")
    kept = sorted((x["doc_id"] is None, x["doc_id"] or 0, x["text"] or "") for x in simhash.keep_one(docs).collect())
    assert kept == sorted([(False, 1, a), (False, 5, b), (True, 0, a), (False, 9, "")])
    twice = spark.createDataFrame([(3, a), (3, a + " more")], "doc_id long, text string")
    assert simhash.keep_one(twice).count() == 1


def test_the_sample_does_not_depend_on_where_rows_lie(spark):
    rows = [(i % 50, f"text {i}") for i in range(500)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    found = set()
    for n in (1, 3, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        found.add(tuple(sorted(map(tuple, common.labelled_sample(docs, labels, "toxic", 30).collect()))))
        rows.reverse()
    assert len(found) == 1 and len(next(iter(found))) == 30
