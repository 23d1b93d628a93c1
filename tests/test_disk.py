"""What queries leave on disk and move between tasks."""

import os

from pyspark.sql import functions as F

from careerloom import vocab as V
from careerloom.operators import graph, view
from careerloom.plans.demo import _STORED, Careers
from careerloom.runtime import cut, scratch, shared_dir
from conftest import rows

SF = "/root/testdata/sf0.001"


def _tables(spark):
    folder = shared_dir(spark).removeprefix("file:")
    return {x for x in os.listdir(folder) if x.startswith("cut")}


def _exchanges(df):
    df.write.format("noop").mode("overwrite").save()
    return str(df._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning")


def test_tables_of_the_build_go_with_it(spark):
    _STORED.pop((spark.sparkContext.applicationId, SF), None)
    before = _tables(spark)
    graph = Careers(spark, SF).triples
    left = _tables(spark) - before
    assert len(left) == 1 and graph.count() > 0


def test_records_go_with_their_last_reader(spark, monkeypatch):
    """When certifications are looked at, nothing reads lines, skills and jobs any more."""
    _STORED.pop((spark.sparkContext.applicationId, SF), None)
    before, seen, plain = _tables(spark), [], graph._cert_key

    def looked_at(certs):
        seen.extend(spark.table(x).columns for x in _tables(spark) - before)
        return plain(certs)

    monkeypatch.setattr(graph, "_cert_key", looked_at)
    stored = Careers(spark, SF).triples
    assert seen and not any({"raw_label", "alt_labels", "achievements"} & set(columns) for columns in seen)
    assert rows(stored) == rows(Careers(spark, SF).build_triples())


def test_parts_that_name_an_entity_twice_are_made_distinct(spark):
    schema = "session_id long, s string, p string, o string, o_kind string, o_type string"
    part = lambda kind: spark.createDataFrame([(1, "a", V.RDF_TYPE, kind, "iri", None), (1, "a", V.NAME, "x", "literal", None)], schema)
    before = _tables(spark)
    got = graph.store_parts(((part(kind).repartition(2, "session_id"), []) for kind in ("org", "skill")), 2)
    assert rows(got, "s", "p", "o") == sorted([("a", V.RDF_TYPE, "org"), ("a", V.RDF_TYPE, "skill"), ("a", V.NAME, "x")])
    assert len(_tables(spark) - before) == 1


def test_scratch_keeps_what_is_taken_out(spark):
    before = _tables(spark)
    with scratch() as made:
        a, b = cut(spark.range(3)), cut(spark.range(4))
        made.remove(b)
    cut(spark.range(1))
    assert b.count() == 4 and len(_tables(spark) - before) == 2 and a is not b


def test_neighbourhoods_lie_by_session(spark):
    """Only the centres, which do not lie by session, are dealt out."""
    c = Careers(spark, SF)
    centers = cut(c.raw_org.select("session_id", F.concat(F.lit("http://x/"), "org_id").alias("center")).limit(5))
    named = c.triples.filter("o_kind = 'iri'").select("session_id", F.col("s").alias("center")).limit(50)
    centers = cut(centers.unionByName(named))
    got = view.ego_nodes(c.triples, centers, depth=3, hub_degree=3, buckets=c.buckets)
    plain = c.triples.filter("o_kind = 'iri'").select("session_id", F.col("s").alias("a"), F.col("o").alias("b")).distinct().toPandas()
    near = {}
    for s, a, b in plain.itertuples(index=False):
        near.setdefault((s, a), set()).add(b)
        near.setdefault((s, b), set()).add(a)
    want = []
    for s, center in {tuple(r) for r in centers.collect()}:
        if (s, center) in near:
            seen, front = {center: 0}, {center}
            for hop in (1, 2, 3):
                front = {y for x in front for y in near[(s, x)]} - set(seen)
                seen.update(dict.fromkeys(front, hop))
            want += [(s, center, x, h) for x, h in seen.items()]
    assert rows(got) == sorted(want, key=lambda t: tuple((x is None, str(x)) for x in t))
    assert _exchanges(got) == 0


def test_json_ld_comes_back_without_an_exchange(spark):
    from careerloom.sources import jsonld_triples, to_jsonld

    c = Careers(spark, SF)
    assert _exchanges(jsonld_triples(to_jsonld(c.triples).select("session_id", "node"))) == 0


def test_states_of_a_batch_are_worked_out_once(spark, tmp_path):
    """The commit writes keys and rows; the stateful stage must not run for each of them."""
    import datetime as dt

    from careerloom.streaming import status

    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    seen = spark.sparkContext.accumulator(0)
    data = [(i, dt.datetime(2024, 1, 1, 0, i), "s", i % 5, "complete", None) for i in range(50)]
    schema = "event_id long, ts timestamp, session_id string, document_id long, event string, payload string"
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(src)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    stream = spark.readStream.schema(schema).parquet(src)
    status.stream_document_status(stream.mapInArrow(counted, stream.schema), out, ckpt).awaitTermination()
    assert seen.value == 50 and status.current_status(spark, out).count() == 5


def test_compressed_tables_are_not_broadcast_unseen(spark):
    """A file of less than 10 MB, the default bound, may hold rows that no driver has room for."""
    Careers(spark, SF)
    wide = spark.range(2_000_000).select(F.pmod(F.xxhash64("id"), F.lit(50_000)).alias("session_id"), F.concat(F.lit("label "), (F.col("id") % 40).cast("string")).alias("label"))
    # Written so that the whole table is one small file.
    table = cut(wide.coalesce(1).sortWithinPartitions("label", "session_id"), codec="zstd")
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size < 10 << 20
    plan = table.join(table.withColumn("x", F.lit(1)), ["session_id", "label"], "left")._jdf.queryExecution().sparkPlan()
    assert "BroadcastHashJoin" not in str(plan)


def test_neighbourhoods_come_with_their_edges(spark):
    """Every statement between two nodes of a neighbourhood is there, worked out one by one."""
    from careerloom.plans.queries import QUERIES

    got = QUERIES["ego_graph"](spark, SF).filter("session_id < 3").collect()
    links = Careers(spark, SF).triples.filter("session_id < 3 and o_kind = 'iri'").select("session_id", "s", "p", "o").distinct().collect()
    inside = {(r.session_id, r.center, r.id) for r in got}
    centers = {x[:2] for x in inside}
    want = {(k, c, s, p, o) for k, s, p, o in links for j, c in centers if j == k and {(k, c, s), (k, c, o)} <= inside}
    assert want and {(r.session_id, r.center, r.id, r.p, r.o) for r in got if r.p} == want
    without = [(r.session_id, r.center, r.id) for r in got if not r.p]
    assert without and len(set(without)) == len(without) and len(got) == len(want) + len(without)
