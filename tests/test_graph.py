"""Identity, construction, view and validation on tiny graphs."""

import datetime as dt
import itertools
import random

import pytest
from test_functions import common_length
from conftest import rows
from pyspark.sql import functions as F

from careerloom import vocab as V
from careerloom.operators import graph as G
from careerloom.operators import sessions as D
from careerloom.operators import validate as H
from careerloom.operators import view
from careerloom.operators.common import position_in, previous_row, resolve_chains
from careerloom.plans.demo import Careers

ORG_MAP = "session_id int, id string, canonical_id string"
JOBS = "session_id int, job_id string, title string, org_id string, start_date date"


def ratio(a, b):
    return 1.0 if a == b else 2 * common_length(a, b) / (len(a) + len(b))


def greedy(jobs, days=30, threshold=0.85):
    """The sequential rule, one job after the other."""
    out, leaders = {}, []
    for jid, title, org, start in sorted(jobs, key=lambda j: (str(j[3] or ""), j[0])):
        for lid, lt, lo, ls in leaders:
            close = (start is None and ls is None) or (start and ls and abs((start - ls).days) <= days)
            if lo == org and close and ratio(title, lt) >= threshold:
                out[jid] = lid
                break
        else:
            leaders.append((jid, title, org, start))
            out[jid] = jid
    return out


def test_a_long_chain_of_jobs_is_one_sweep(spark, monkeypatch):
    """Every second job of a chain is absorbed; how many tables are written does not depend on its length."""
    from careerloom import runtime

    written = []
    monkeypatch.setattr(G, "cut", lambda df: written.append(1) or runtime.cut(df))
    counts = []
    for n in (4, 40):
        jobs = [(f"j{i:03d}", "engineer" + "s" * (i % 2), "a", dt.date(2020, 1, 1) + dt.timedelta(20 * i)) for i in range(n)]
        before = len(written)
        df = spark.createDataFrame([(1, *j) for j in jobs], JOBS)
        got = {r.id: r.canonical_id for r in G.dedup_jobs(df, spark.createDataFrame([], ORG_MAP)).collect()}
        assert got == greedy(jobs) and got["j003"] == "j002"
        counts.append(len(written) - before)
    assert counts[0] == counts[1]


@pytest.mark.parametrize("seed", [1, 2])
def test_fuzzy_jobs_equal_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    titles = ["software engineer", "software engineers", "sr software engineer", "software engineer ii", "data analyst", "data analysts", "data analyst i", "cook", ""]
    jobs = []
    for i in range(120):
        start = None if rng.random() < 0.1 else dt.date(2020, 1, 1) + dt.timedelta(rng.randrange(150))
        jobs.append((f"j{i:03d}", rng.choice(titles), rng.choice(["a", "b"]), start))
    df = spark.createDataFrame([(1, *j) for j in jobs], JOBS)
    got = {r.id: r.canonical_id for r in G.dedup_jobs(df, spark.createDataFrame([], ORG_MAP)).collect()}
    assert got == greedy(jobs)


def test_similar_titles_misses_no_pair(spark):
    rng = random.Random(5)
    words = ["data", "senior", "engineer", "analyst", "lead", "of", "web"]
    titles = sorted({" ".join(rng.choices(words, k=rng.randrange(1, 4))) + rng.choice(["", "s", " i", "."]) for _ in range(150)} | {"a", "ab", "abc", "abd"})
    df = spark.createDataFrame([(1, "o", t) for t in titles], "session_id int, org_key string, title_key string")
    got = set(rows(G.similar_titles(df), "title_new", "title_old"))
    want = {(a, b) for a, b in itertools.product(titles, titles) if ratio(a, b) >= 0.85}
    assert got == want


def entity(spark, schema, data):
    return spark.createDataFrame(data, schema)


BASE = "confidence double, source_doc string, created_at timestamp_ntz, pos long"
B = (1.0, "d.txt", dt.datetime(2020, 1, 1), 1)


@pytest.fixture(scope="module")
def world(spark):
    """Two documents of one person: skills and organizations repeat under other ids."""
    arr = "array<string>"
    skills = entity(
        spark,
        f"session_id int, doc_id string, skill_id string, label string, category string, proficiency_level string, years_experience double, skos_uri string, "
        f"broader_concepts {arr}, narrower_concepts {arr}, related_concepts {arr}, alt_labels {arr}, definition string, {BASE}",
        [
            (1, "d1", "s1", "Python", "Technical", None, 3.0, "urn:skill:py", ["programming"], [], [], [], None, *B),
            (1, "d2", "s2", " python", None, None, None, None, [], [], [], ["Py"], None, *B),
            (1, "d2", "s3", "SQL", None, None, None, None, [], [], [], [], None, *B),
        ],
    )
    orgs = entity(
        spark,
        f"session_id int, doc_id string, org_id string, name string, org_type string, industry string, location string, website string, description string, {BASE}",
        [(1, "d1", "o1", "BigCo", None, None, None, None, None, *B), (1, "d2", "o2", "The BigCo, Inc.", None, None, None, None, None, *B)],
    )
    jobs = entity(
        spark,
        f"session_id int, doc_id string, job_id string, title string, org_id string, start_date date, end_date date, is_current boolean, location string, description string, achievements {arr}, {BASE}",
        [
            (1, "d1", "j1", "Engineer", "o1", dt.date(2020, 1, 1), None, True, None, None, ["Won", "Won"], *B),
            (1, "d2", "j2", "engineer", "o2", dt.date(2020, 1, 10), None, True, None, None, [], *B),
            (1, "d2", "j3", "Cook", "ghost", None, None, False, None, None, [], *B),
        ],
    )
    js = entity(
        spark, "session_id int, job_id string, skill_id string, kind string",
        [(1, "j1", "s1", "technology"), (1, "j1", "s2", "technology"), (1, "j2", "s3", "skill"), (1, "j3", "lost", "skill")],
    )
    edu = entity(
        spark,
        f"session_id int, doc_id string, edu_id string, label string, degree_type string, field_of_study string, institution_id string, start_date date, end_date date, "
        f"is_current boolean, location string, description string, gpa double, {BASE}",
        [(1, f"d{i}", f"e{i}", "BS", "BS" if i == 1 else "bs", "Math", "o1", None, None, False, None, None, None, *B) for i in (1, 2)],
    )
    certs = entity(
        spark,
        f"session_id int, doc_id string, cert_id string, name string, issuing_organization string, issue_date date, expiration_date date, credential_id string, credential_url string, is_active boolean, {BASE}",
        [(1, "d1", "c1", "CKA", "CNCF", None, dt.date(2020, 1, 1), None, None, True, *B), (1, "d2", "c2", "cka", "cncf", None, None, None, None, True, *B)],
    )
    persons = entity(
        spark, f"session_id int, doc_id string, person_id string, name string, email string, phone string, location string, summary string, {BASE}",
        [(1, d, p, "Ann Lee", None, None, None, None, *B) for d, p in (("d1", "p1"), ("d2", "p2"))],
    )
    refs = entity(
        spark, "session_id int, person_id string, kind string, id string",
        [
            (1, "p1", "job", "j1"), (1, "p2", "job", "j2"), (1, "p2", "job", "j3"), (1, "p1", "skill", "s1"), (1, "p2", "skill", "s2"), (1, "p2", "skill", "s3"),
            (1, "p1", "education", "e1"), (1, "p2", "education", "e2"), (1, "p2", "certification", "c2"), (1, "p2", "certification", "nowhere"),
        ],
    )
    g = G.build_graph(
        D.merge_persons(persons), D.merged_references(refs, persons), jobs, js, skills, edu, certs, orgs, F.lit(dt.date(2021, 1, 1))
    )
    return g.cache()


def test_graph_counts(world):
    s = G.graph_stats(world).first()
    assert (s.person_count, s.job_count, s.skill_count, s.education_count, s.certification_count, s.organization_count) == (1, 2, 2, 1, 1, 1)
    assert world.count() == world.distinct().count()


def test_graph_edges(world):
    def objs(p):
        return rows(world.filter(F.col("p") == p), "s", "o")

    r = V.RES
    assert objs(V.HAS_SKILL) == [(r + "p1", r + "s1"), (r + "p1", r + "s3")]
    assert objs(V.HAS_JOB) == [(r + "p1", r + "j1"), (r + "p1", r + "j3")]
    # A duplicate job is dropped with its skills; one edge per technology and job.
    assert objs(V.USED_TECH) == [(r + "j1", r + "s1")]
    assert objs(V.USED_SKILL) == [(r + "j3", r + "lost")]
    # Unresolved job references stay visible, unresolved person references do not.
    assert objs(V.HIRING_ORG) == [(r + "j1", r + "o1"), (r + "j3", r + "ghost")]
    assert objs(V.HAS_CERT) == [(r + "p1", r + "c1")]
    assert objs(V.ALT_LABEL) == [(r + "s1", "Py")]
    assert [o for _, o in objs(V.ACHIEVEMENT)] == ["Won"]
    assert [o for _, o in objs(V.ONT + "isExpired")] == ["true"]


def test_validation(world):
    found = {(i.level, i.check, i.subject.rsplit("/", 1)[-1]) for i in H.all_issues(world).collect()}
    assert found == {
        ("error", "dangling_reference", "j3"),
        ("warning", "skos_dangling", "s1"),
        ("warning", "job_missing_dates", "j3"),
    }
    rep = H.validation_report(world).first()
    # Both dangling edges of j3 count: its organization and its skill.
    assert (rep.valid, rep.errors, rep.warnings) == (False, 2, 2)


def triples(spark, data):
    return spark.createDataFrame(
        [(1, s, p, o, "iri" if o.startswith("urn:") or p == V.RDF_TYPE else "literal", None if p == V.RDF_TYPE else t) for s, p, o, t in data],
        "session_id int, s string, p string, o string, o_kind string, o_type string",
    )


def test_near_duplicates_and_completeness(spark):
    t = triples(
        spark,
        [x for i, label in enumerate(["Node.js", "NodeJS", "C++", "Node.js"]) for x in
         [(f"{V.RES}{i}", V.RDF_TYPE, V.TYPE_IRI["skill"], None), (f"{V.RES}{i}", V.PREF_LABEL, label, V.XSD_STRING)]],
    )
    issue = H.near_duplicate_skills(t).collect()
    assert [i.message for i in issue] == ["Skill labels ['Node.js', 'NodeJS'] look like variants of the same skill"]
    assert H.no_person(t).count() == 1
    want = spark.createDataFrame([(1, "skill", 9), (1, "job", 2), (1, "person", 0)], "session_id int, kind string, extracted long")
    assert rows(H.completeness(t, want), "check", "subject") == [("low_entity_count", "skill"), ("type_missing_in_export", "job")]


def test_shapes(spark):
    j, bad = V.RES + "j", "http://x/y"
    t = triples(
        spark,
        [
            (j, V.RDF_TYPE, V.TYPE_IRI["job"], None), (j, V.START, "2020", V.XSD_STRING), (j, V.START, "2020-01-01", V.XSD_DATE),
            (j, V.USED_TECH, "Python", V.XSD_STRING), (j, V.CONFIDENCE, "1", V.XSD_DOUBLE), (j, V.CONFIDENCE, "x", V.XSD_STRING),
            (j, V.HIRING_ORG, "urn:o", None),
        ],
    )
    assert rows(H.check_shapes(t), "rule", "constraint", "n_values") == [
        ("job_confidence", "datatype", 1), ("job_confidence", "max_count", 2), ("job_start", "datatype", 1), ("job_start", "max_count", 2),
        ("job_technology", "node_kind", 1), ("job_title", "min_count", 0),
    ]
    assert rows(H.unlabelled_organizations(t), "subject") == [("urn:o",)]
    assert bad not in str(rows(H.unlabelled_certifications(t)))


def test_view(world):
    n = {r.id.rsplit("/", 1)[-1]: r for r in view.nodes(world).collect()}
    assert (n["p1"].label, n["p1"].kind, n["p1"].size) == ("Ann Lee", "person", 30)
    assert n["ghost"].kind == "unknown" and n["lost"].kind == "unknown" and n["programming"].kind == "unknown"
    u = {r.label: (r.degree, r.connected) for r in view.unknown_nodes(world).collect()}
    assert u == {"ghost": (1, "Cook"), "lost": (1, "Cook"), "programming": (1, "Python")}
    shown, kept = view.visible_subgraph(view.node_labels(world), view.edges(world), ["unknown", "skill"])
    assert "skill" not in {r.kind for r in shown.collect()} and kept.filter(F.col("p") == V.HAS_SKILL).count() == 0
    tip = {r.id.rsplit("/", 1)[-1]: r.tooltip for r in view.node_tooltip(world).collect()}
    assert tip["j1"] == "<b>Engineer</b><br><i>Type: job</i><br>Title: Engineer<br>Organization: BigCo"


def test_hubs_stay_factors(spark):
    """All members of a hub as centres: the factors grow with the members, and multiply out to what a plain search finds."""
    n = 40
    edges = [(f"m{i}", "hub") for i in range(n)] + [(f"m{i}", f"x{i % 7}") for i in range(n)] + [("hub", "top"), ("x0", "x1"), ("top", "far")]
    t = spark.createDataFrame([(1, a, "p", b, "iri", None) for a, b in edges], "session_id int, s string, p string, o string, o_kind string, o_type string")
    centers = spark.createDataFrame([(1, f"m{i}") for i in range(n)] + [(1, "hub"), (1, "far")], "session_id int, center string")
    near, hubs, rings = view.ego_reach(t, centers, 2, hub_degree=20)
    assert near.count() < 20 * n and hubs.count() <= n + 2 and rings.count() < 3 * n
    for depth in (1, 2, 3):
        want = rows(view.ego_nodes(t, centers, depth, hub_degree=10**6), "center", "id", "hops")
        for degree in (20, 5, 1):
            assert rows(view.ego_nodes(t, centers, depth, hub_degree=degree), "center", "id", "hops") == want


def test_a_stored_graph_is_read_where_it_lies(spark, world):
    stored = G.store(world)
    assert rows(stored) == rows(world)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(H.node_facts(stored)) and "Bucketed: true" in plan(H.node_facts(stored))
    assert plan(H.node_rules(stored)).count("Exchange") == 0
    # Of the nodes only the ends of edges move.
    assert plan(view.node_labels(stored)).count("Exchange") <= 2
    assert rows(H.validation_report(stored)) == rows(H.validation_report(world))
    assert rows(view.nodes(stored)) == rows(view.nodes(world))


def test_ego_graph(spark, world):
    centers = spark.createDataFrame([(1, V.RES + "s3"), (1, V.RES + "missing")], "session_id int, center string")
    near, inside = view.ego_graph(world, centers, 1)
    assert {r.id.rsplit("/", 1)[-1] for r in near.collect()} == {"s3", "p1", "Skill"}
    assert inside.count() == 2
    two, _ = view.ego_graph(world, centers, 2)
    assert {"j1", "e1", "s1", "c1"} <= {r.id.rsplit("/", 1)[-1] for r in two.collect()}


def test_pattern_queries(world):
    assert rows(G.unowned_used_skills(world), "skill") == [(V.RES + "lost",)]
    assert G.skills_in_jobs_titled(world, "cook").count() == 0  # the lost skill has no label


def test_chains_and_cycles(spark):
    links = [("a", "b"), ("b", "c"), ("x", "z"), ("z", "y"), ("y", "x"), ("q", "z"), ("s", "s")]
    links += [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(200)]
    links += [(f"c{i:03d}", f"c{(i + 7) % 200:03d}") for i in range(200)] + [(f"a{i:03d}", f"a{i + 1:03d}" if i < 49 else "c100") for i in range(50)]
    df = spark.createDataFrame([(1, *e) for e in links], "session_id int, src string, dst string")
    got = {r.src: r.dst for r in resolve_chains(df, ["session_id"]).collect()}
    assert got == {"a": "c", "b": "c", "z": "x", "y": "x", "q": "x", **{f"n{i:03d}": "n200" for i in range(200)}, **{f"c{i:03d}": "c000" for i in range(1, 200)}, **{f"a{i:03d}": "c000" for i in range(50)}}


def test_order_helpers_cross_chunks(spark):
    rng = random.Random(3)
    data = [(k, rng.randrange(1000), i) for i, k in enumerate(["a"] * 200 + ["b"] * 3)]
    df = spark.createDataFrame(data, "k string, t int, i int")
    chunk = F.floor(F.col("t") / 100)
    pos = {r.i: r.p for r in position_in(df, ["k"], chunk, ["t", "i"], "p").collect()}
    prev = {r.i: r.prev.i if r.prev else None for r in previous_row(df, ["k"], chunk, ["t", "i"], ["i"]).collect()}
    for key in "ab":
        order = [i for _, i in sorted((t, i) for k, t, i in data if k == key)]
        assert [pos[i] for i in order] == list(range(1, len(order) + 1))
        assert [prev[i] for i in order] == [None, *order[:-1]]


def test_tables_by_session_give_the_same_graph_and_move_no_triple(spark):
    c = Careers(spark, "/root/testdata/sf0.001")
    placed, stored = c.build_triples(), c.triples
    plain = G.build_graph(c.merged_person, c.merged_refs, c.job, c.job_skill, c.raw_skill, c.raw_edu, c.raw_cert, c.raw_org, c.as_of)
    want = rows(plain)
    assert len(want) > 1000 and rows(placed) == want and rows(stored) == want
    ends = stored.filter("o_kind = 'iri'").select("session_id", "o")
    near = ends.join(stored.select("session_id", stored.s.alias("o"), "p").hint("merge"), ["session_id", "o"])
    for df in (stored.groupBy("session_id").count(), stored.groupBy("session_id", "s").count(), near):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["person_edges", "unresolved_person_refs"])
def test_references_are_resolved_from_stored_tables(spark, name):
    """One plan over all the given tables held a broadcast per use of each on the driver."""
    from __spark_entry__ import queries

    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "sf0.001" not in plan


def test_stored_records_lie_by_session(spark):
    from careerloom.plans.queries.uploads import records

    c = Careers(spark, "/root/testdata/sf0.001").store("line", "raw_skill")
    again = c.raw_skill
    assert c.store("raw_skill").raw_skill is again
    for df in (c.raw_skill, records(c)):
        assert "Exchange" not in df.groupBy("session_id", "doc_id").count()._jdf.queryExecution().executedPlan().toString()
