"""Label reconciliation on hand-made pools."""

import pytest
from conftest import rows

from careerloom import vocab as V
from careerloom.operators import normalize as N

LABELS = "session_id int, pool string, label string, declared boolean, verified boolean, uri string"
GROUPS = "session_id int, pool string, canonical string, members array<string>, reasoning string"


def final(spark, labels, groups=(), **kw):
    df = spark.createDataFrame(labels, LABELS)
    m = N.build_label_map(df, spark.createDataFrame(list(groups), GROUPS), **kw)
    return {(r.pool, r.label): (r.canonical, r.phase) for r in m.collect()}


def test_phases_chain(spark):
    got = final(
        spark,
        [
            (1, "skill", "machine learning", False, False, None), (1, "skill", "Machine Learning", True, False, "u:ml"),
            (1, "skill", "ML", False, False, None), (1, "skill", "Stat Learning", True, False, "u:ml"), (1, "skill", "GA4", True, True, None),
            (1, "org", "MS", False, False, None), (1, "degree", "ms", False, False, None),
        ],
        [(1, "skill", "Deep ML", ["Machine Learning", "ML", "Deep ML"], ""), (1, "skill", "AI", ["AI", "Deep ML"], ""), (1, "skill", "Analytics", ["GA4", "Analytics"], "")],
    )
    assert got["skill", "machine learning"] == ("AI", "alias")
    assert got["skill", "Stat Learning"] == ("AI", "alias")
    assert got["skill", "ML"] == ("AI", "alias")
    assert got["skill", "GA4"] == ("GA4", "verified")
    # Equal texts of different kinds stay apart.
    assert got["org", "MS"] == ("MS", "none") and got["degree", "ms"] == ("ms", "none")


def test_canonical_choice_is_total(spark):
    labels = [(1, "skill", x, x == "python", False, None) for x in ("python", "PYTHON", "Python")]
    assert {v[0] for v in final(spark, labels).values()} == {"PYTHON"}  # capitalised, equal length, smallest
    assert {v[0] for v in final(spark, labels, prefer_declared=True).values()} == {"python"}


def test_sessions_do_not_mix(spark):
    got = N.phase1_case(spark.createDataFrame([(1, "skill", "SQL", True, False, None), (2, "skill", "sql", True, False, None)], LABELS))
    assert got.count() == 0


def test_apply(spark):
    skills = spark.createDataFrame(
        [(1, "a", "ML", False, ["x"]), (1, "b", "ML", True, None), (1, "c", "Data%20Science", None, None)],
        "session_id int, skill_id string, label string, user_verified boolean, alt_labels array<string>",
    )
    m = spark.createDataFrame([(1, "skill", "ML", "Machine Learning"), (1, "skill", "Data Science", "Data Science")], "session_id int, pool string, label string, canonical string")
    got = {r.skill_id: (r.label, list(r.alt_labels)) for r in N.apply_to_skills(skills, m).collect()}
    assert got == {"a": ("Machine Learning", ["x", "ML"]), "b": ("ML", []), "c": ("Data Science", [])}
    tech = spark.createDataFrame([(1, "j", 1, "SQL"), (1, "j", 2, "ML"), (1, "j", 3, "Machine Learning")], "session_id int, job_id string, pos int, label string")
    assert rows(N.apply_to_job_tech(tech, m), "pos", "label") == [(1, "SQL"), (2, "Machine Learning")]


def test_rewrite_triples(spark):
    s, j = V.RES + "s", V.RES + "j"
    lit = V.XSD_STRING
    t = spark.createDataFrame(
        [
            (1, s, V.RDF_TYPE, V.TYPE_IRI["skill"], "iri", None), (1, s, V.PREF_LABEL, "ml", "literal", lit), (1, s, V.EXACT_MATCH, "urn:ml", "iri", None),
            (1, j, V.PREF_LABEL, "ml", "literal", lit), (1, j, V.USED_TECH, "ml", "literal", lit), (1, j, V.USED_TECH, "ML%20x", "literal", lit),
            (1, j, V.USED_TECH, V.RES + "ml", "iri", None), (1, j, V.USED_TECH, V.RES + "uuid-1", "iri", None),
        ],
        "session_id int, s string, p string, o string, o_kind string, o_type string",
    )
    m = spark.createDataFrame(
        [(1, "skill", "ml", "Machine Learning"), (1, "skill", "ML x", "Machine Learning"), (1, "skill", "Machine Learning", "Machine Learning")],
        "session_id int, pool string, label string, canonical string",
    )
    got = rows(N.rewrite_triples(t, m), "s", "p", "o")
    assert got == sorted(
        [
            (s, V.RDF_TYPE, V.TYPE_IRI["skill"]), (s, V.PREF_LABEL, "Machine Learning"), (s, V.ALT_LABEL, "ml"), (s, V.ALT_LABEL, "ML x"), (s, V.EXACT_MATCH, "urn:ml"),
            (j, V.PREF_LABEL, "ml"), (j, V.USED_TECH, "Machine Learning"), (j, V.USED_TECH, V.RES + "Machine%20Learning"), (j, V.USED_TECH, V.RES + "uuid-1"),
        ],
        key=lambda r: tuple((False, x) for x in r),
    )


@pytest.mark.parametrize("single,n", [(False, 1), (True, 2)])
def test_phase_gate(spark, single, n):
    groups = spark.createDataFrame([(1, "skill", "a", ["a", "b"], ""), (2, "skill", "a", ["a", "b"], "")], GROUPS)
    docs = spark.createDataFrame([(1, "complete"), (1, "complete"), (2, "complete"), (2, "error")], "session_id int, status string")
    assert N.phase_gate(groups, docs, single).count() == n


def test_report_totals(spark):
    m = spark.createDataFrame(
        [(1, "skill", x, c, p) for x, c, p in (("a", "A", "case"), ("A", "A", "none"), ("b", "A", "alias"))],
        "session_id int, pool string, label string, canonical string, phase string",
    )
    r = N.normalization_report(m).first()
    assert (r.original_labels, r.final_unique_labels, r.total_merges, r.case_merges, r.alias_merges, r.reduction_pct) == (3, 1, 2, 1, 1, 66.7)
