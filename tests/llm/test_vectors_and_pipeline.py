"""Operators on vectors against brute force, components, and the pipeline's stages."""

import random

import numpy as np
import pytest

import corpus_pipeline
from careerloom.llm import lattice, passages, topk
from careerloom.llm.components import components
from careerloom.llm.queries import ORACLES, QUERIES


def vectors(spark, rows):
    return spark.createDataFrame(
        [(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x") for i, v in rows],
        "vec_id long, embedding array<double>, score int, cell string",
    )


@pytest.fixture(scope="module")
def odd():
    nan, inf = float("nan"), float("inf")
    return [(900, None), (901, []), (902, [0.0] * 16), (903, [nan] + [1.0] * 15), (904, [inf] + [1.0] * 15), (905, [None] + [1.0] * 15), (None, [1.0] * 16)]


def test_components(spark):
    r = random.Random(1)
    for n, m in ((50, 20), (200, 150), (60, 200)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, None)]
        got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        label = {x: x for e in edges if None not in e for x in e}
        for _ in range(len(label)):
            for a, b in edges:
                if b is not None:
                    label[a] = label[b] = min(label[a], label[b])
        assert got == label
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_e8_decoding_is_nearest():
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 8))
    got = lattice.nearest_e8(x)
    far = ((x - got) ** 2).sum(1)
    assert np.allclose((2 * got) % 1, 0) and (far <= 1 + 1e-9).all()
    for step in lattice.shortest_e8():
        assert (((x - got - step) ** 2).sum(1) >= far - 1e-9).all()


def test_lattice_equals_brute_force(spark, odd):
    r = np.random.default_rng(2)
    base = r.normal(size=(40, 64))
    rows = [(i, base[i % 40] + (r.normal(size=64) * 0.08 if i >= 40 else 0)) for i in range(200)]
    rows += [(300 + i, rows[3][1]) for i in range(5)] + [(4, rows[4][1])] + odd + [(950, [1.0] * 16), (951, [2.0] * 16)]
    got = lattice.near_duplicates(vectors(spark, rows), piece=16).collect()
    assert len(got) == len(rows)
    links, near = [0] * len(rows), []
    usable = [i is not None and v is not None and len(v) > 0 and None not in list(v) and np.isfinite(np.array(v, float)).all() and np.any(v) for i, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if u else None for u, (_, v) in zip(usable, rows)]
    label = {i: i for i, _ in rows}
    for a in range(len(rows)):
        for b in range(a):
            if usable[a] and usable[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95:
                links[a], links[b] = links[a] + 1, links[b] + 1
                near.append((rows[a][0], rows[b][0]))
    for _ in range(20):
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    want = sorted((str(i), n, str(label[i]), str(None if i is None else label[i] == i)) for (i, _), n in zip(rows, links))
    assert sorted((str(x["vec_id"]), x["n_links"], str(x["component_id"]), str(x["kept"])) for x in got) == want
    assert lattice.near_duplicates(vectors(spark, rows).limit(0)).count() == 0


def test_lattice_recall_at_the_bound(spark):
    """Pairs right above the bound are the hardest ones."""
    r = np.random.default_rng(7)
    rows = []
    for i in range(300):
        a = r.normal(size=64)
        a /= np.linalg.norm(a)
        b = r.normal(size=64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a), (2 * i + 1, 0.951 * a + np.sqrt(1 - 0.951**2) * b)]
    got = lattice.near_duplicates(vectors(spark, rows)).agg({"n_links": "sum"}).first()[0]
    assert got / 600 >= 0.97


def test_top_k_equals_brute_force(spark, odd):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=16).round(1)) for i in range(400)] + [(500 + i, [0.5] * 16) for i in range(30)] + [(7, [0.5] * 16)] + odd
    df = vectors(spark, rows)
    got = topk.top_k(df, df.filter("vec_id % 100 = 0"), tile=32, query_tile=2, fan_in=2).collect()
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and len(v) == 16 and None not in list(v) and np.isfinite(np.array(v, float)).all()]
    want = []
    for q, u in whole:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(u, v)), i) for i, v in whole if i != q)[:10]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in got) == sorted(want)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    assert topk.top_k(df.filter("vec_id in (100, 1, 2)"), df.filter("vec_id = 100")).count() == 2


def test_every_operator_is_registered():
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    from oracle_check import compare, connect

    sf = "/root/testdata/sf0.001"
    got, want = QUERIES[name](spark, sf).toPandas(), connect(sf).execute(ORACLES[name]).df()
    assert len(want) > 0 and compare(got, want) == ""


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, docs, sf).cache()
        assert after.columns == list(corpus_pipeline.COLUMNS)
        assert 0 < after.count() <= docs.count()
        docs = after
    assert docs.count() < before
    assert passages.repeated_passages(docs).filter("removed").count() == 0
    words = sum(len(r["text"].split()) for r in docs.collect())
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, sf)
    assert mixed.columns == list(corpus_pipeline.COLUMNS)
    assert abs(sum(len(r["text"].split()) for r in mixed.collect()) - words) <= 0.05 * words
    assert corpus_pipeline.STAGES[4][1](spark, mixed, sf).count() == mixed.count()
