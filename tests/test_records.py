"""Sources, extraction records, sessions and corrections."""

import json
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from careerloom.sources.versions import VersionedTables
from careerloom import schemas, sources
from careerloom import vocab as V
from careerloom.operators import assemble as C
from careerloom.operators import sessions as D
from careerloom.plans import prompts as P


def record_frame(spark, *records):
    data = [("S", f"d{i}", f"d{i}.txt", json.dumps(r)) for i, r in enumerate(records)]
    df = spark.createDataFrame(data, "session_id string, doc_id string, source_doc string, j string")
    parsed = df.select("session_id", "doc_id", "source_doc", F.from_json("j", schemas.ENTITY_RECORD).alias("r"))
    names = [f.name for f in schemas.ENTITY_RECORD.fields if f.name != "_corrupt_record"]
    return parsed.select("session_id", "doc_id", "source_doc", *[F.col(f"r.{n}").alias(n) for n in names])


def test_register_orgs(spark):
    raw = record_frame(
        spark,
        {
            "organizations": [
                {"id": "org-acme", "name": "Acme Corp", "org_type": None},
                {"id": "org-{{uuid}}", "name": "Beta Labs"},
                {"id": "org-acme", "name": "Acme International", "location": "Oslo"},
                {"name": "acme corp", "website": "ignored"},
            ],
            "jobs": [
                {"title": "a", "organization_id": "org-acme"},
                {"title": "b", "company": "BETA labs"},
                {"title": "c", "company": "New Co", "organization_id": "org-new"},
                {"title": "d"},
                {"title": "e", "organization_id": "org-new"},
            ],
            "education": [{"degree_type": "BS", "institution": "MIT"}, {"degree_type": "MS", "institution": "mit "}],
        },
    )
    orgs, mentions = C.register_orgs(raw)
    got = {r.org_id: (r.name, r.org_type, r.location, r.website) for r in orgs.collect()}
    assert got == {
        # Alias and name lead to one organization; only the alias mention fills a gap.
        "org-acme": ("Acme Corp", "Company", "Oslo", None),
        "org-beta-labs": ("Beta Labs", None, None, None),
        "org-new": ("New Co", "Company", None, None),
        "org-mit": ("MIT", "University", None, None),
    }
    jobs = {r.title: r.org_id for r in C.build_jobs(raw, mentions).collect()}
    assert jobs == {"a": "org-acme", "b": "org-beta-labs", "c": "org-new", "d": "", "e": "org-new"}
    edu = C.build_education(raw, mentions, orgs)
    assert rows(edu, "degree_type", "institution_id", "label") == [("BS", "org-mit", "BS"), ("MS", "org-mit", "MS")]


def test_slug_collisions(spark):
    raw = record_frame(spark, {"organizations": [{"name": "A & B"}, {"name": "a-b"}, {"name": "A  b"}]})
    assert rows(C.register_orgs(raw)[0], "org_id") == [("org-a-b",), ("org-a-b-2",), ("org-a-b-3",)]


def test_skill_names_resolve_or_are_created(spark):
    raw = record_frame(
        spark,
        {"skills": [{"label": "Python"}, {"label": "SQL", "category": "Data"}], "jobs": [{"title": "x", "skills_used": ["Python", "python", ""], "technologies_used": ["python", "SQL"]}]},
    )
    out = C.assemble(raw)
    assert rows(out["skills"], "label", "category") == [("Python", None), ("SQL", "Data"), ("python", "Technical")]
    assert out["job_skill"].count() == 4 and out["job_skill"].join(out["skills"], "skill_id", "left_anti").count() == 0
    assert rows(out["person_refs"].groupBy("kind").count()) == [("job", 1), ("skill", 3)]


def test_scan_documents(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes("café".encode())
    (tmp_path / "b.md").write_bytes(b"caf\xe9 ok")
    (tmp_path / "c.exe").write_bytes(b"x")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    text, rejects = sources.scan_documents(spark, str(tmp_path))
    assert rows(text, "filename", "extension", "text") == [("a.TXT", ".txt", "café"), ("b.md", ".md", "café ok")]
    assert rows(rejects, "filename") == [("c.exe",), ("d.pdf",)]
    up, _ = sources.scan_documents(spark, str(tmp_path), mode="upload")
    assert ("b.md", "caf ok") in rows(up, "filename", "text")
    with_pdf, left = sources.scan_documents(spark, str(tmp_path), decoder=lambda pdf: pdf["filename"] + "!")
    assert ("d.pdf", "d.pdf!") in rows(with_pdf, "filename", "text") and rows(left, "filename") == [("c.exe",)]


def test_scan_and_write_entities(spark, tmp_path):
    for s, d, body in (("s1", "d1", json.dumps({"person": {"name": "Ann"}, "skills": [{"label": "x", "unknown_key": 1}]})), ("s1", "d2", "{broken")):
        folder = tmp_path / "sessions" / s / "extracted"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{d}.json").write_text(body)
    good, bad = sources.scan_entities(spark, str(tmp_path / "sessions"))
    assert rows(good, "session_id", "doc_id", "person.name") == [("s1", "d1", "Ann")]
    assert rows(bad, "session_id", "doc_id") == [("s1", "d2")]
    out = str(tmp_path / "table")
    sources.write_entities(good, out, buckets=4)
    assert spark.read.parquet(out).select("doc_id").first()[0] == "d1"
    assert [d for d in os.listdir(out) if d.startswith("session_bucket=")]


def test_session_index_and_gold(spark, tmp_path):
    index = {"sessions": [{"id": "s1", "name": "n", "documents": ["d1"], "updated_at": "2024"}], "documents": [{"id": "d1", "filename": "a.txt", "status": "complete"}]}
    (tmp_path / "index.json").write_text(json.dumps(index))
    sessions, documents = sources.scan_session_index(spark, str(tmp_path / "index.json"))
    assert rows(sessions, "session_id", "name") == [("s1", "n")]
    assert rows(documents, "session_id", "document_id", "status") == [("s1", "d1", "complete")]
    gold = tmp_path / "gold"
    gold.mkdir()
    (gold / "r1.expected.json").write_text(json.dumps({"person": {"name": "A"}, "skills": ["SQL"], "jobs": [{"title": "Dev"}], "education": []}))
    (gold / "r1.extracted.json").write_text(json.dumps({"person": {"name": "A"}, "skills": [{"label": "sql"}]}))
    items = sources.scan_gold(spark, str(gold))
    assert rows(items, "variant", "etype", "text", "label", "name", "title") == sorted(
        [
            ("raw", "skills", "SQL", None, None, None), ("raw", "jobs", None, None, None, "Dev"), ("raw", "person", None, None, "A", None),
            ("extracted", "skills", None, "sql", None, None), ("extracted", "person", None, None, "A", None),
        ],
        key=lambda t: tuple((x is None, str(x)) for x in t),
    )
    (tmp_path / "manifest.json").write_text(json.dumps({"fixtures": [{"id": "r1", "absent_types": ["education"], "has_normalized_expected": False}]}))
    assert rows(sources.scan_manifest(spark, str(tmp_path / "manifest.json")), "id", "has_normalized_expected") == [("r1", False)]
    (tmp_path / "run.json").write_text(json.dumps({"test_cases": [{"test_id": "T1", "status": "PASS"}], "provider_metrics": [{"provider": "p", "entities_extracted": {"jobs": 2}}]}))
    cases, metrics = sources.scan_test_run(spark, str(tmp_path / "run.json"))
    assert cases.count() == 1 and metrics.first().entities_extracted == {"jobs": 2}


def test_jsonld_files_round_trip(spark, tmp_path):
    t = spark.createDataFrame(
        [
            ("g", V.RES + "a", V.RDF_TYPE, V.TYPE_IRI["skill"], "iri", None), ("g", V.RES + "a", V.PREF_LABEL, 'say "hi"\n\\x', "literal", V.XSD_STRING),
            ("g", V.RES + "a", V.YEARS, "2.5", "literal", V.XSD_DOUBLE), ("g", V.RES + "a", V.BROADER, V.RES + "b", "iri", None), ("g", V.RES + "a", V.BROADER, V.RES + "c", "iri", None),
        ],
        "session_id string, s string, p string, o string, o_kind string, o_type string",
    )
    nodes = [r.node for r in sources.to_jsonld(t).collect()]
    (tmp_path / "g.jsonld").write_text("[" + ",".join(nodes) + "]")
    assert json.loads(nodes[0])[V.PREF_LABEL] == [{"@value": 'say "hi"\n\\x'}]
    back = sources.scan_jsonld(spark, str(tmp_path / "g.jsonld"))
    assert rows(back) == rows(t.select(*back.columns))
    foreign = [{"@id": "http://old/r#1", "@type": ["http://old/o#T"], "http://old/o#n": [{"@value": 3}, {"@value": True}, {"@value": 1.5}], "http://old/o#d": "x"}]
    (tmp_path / "f.jsonld").write_text(json.dumps(foreign, indent=1))
    got = sources.scan_jsonld(spark, str(tmp_path / "f.jsonld"), {"http://old/o#": V.ONT})
    assert rows(got, "p", "o", "o_type") == sorted(
        [(V.RDF_TYPE, V.ONT + "T", None), (V.ONT + "n", "3", V.XSD + "integer"), (V.ONT + "n", "true", V.XSD_BOOLEAN), (V.ONT + "n", "1.5", V.XSD_DOUBLE), (V.ONT + "d", "x", V.XSD_STRING)],
        key=lambda t: tuple((x is None, str(x)) for x in t),
    )
    sources.write_jsonld(t, str(tmp_path / "out"))
    sources.write_turtle(t, str(tmp_path / "ttl"))
    line = [r.value for r in spark.read.text(str(tmp_path / "ttl")).collect() if "prefLabel" in r.value]
    assert line == [f'<{V.RES}a> <{V.PREF_LABEL}> "say \\"hi\\"\\n\\\\x" .']


def test_merge_persons_by_name(spark):
    p = spark.createDataFrame(
        [(1, "d1", "p1", "Ann"), (1, "d2", "p2", " ann"), (1, "d3", "p3", "Bob"), (2, "d1", "p9", "Cy")], "session_id int, doc_id string, person_id string, name string"
    )
    assert rows(D.merge_persons(p), "session_id", "person_id") == [(1, "p1"), (2, "p9")]
    assert rows(D.merge_persons(p, by_name=True), "person_id") == [("p1",), ("p3",), ("p9",)]
    refs = spark.createDataFrame([(1, "p2", "job", "j"), (1, "p3", "job", "k")], "session_id int, person_id string, kind string, id string")
    assert rows(D.merged_references(refs, p, by_name=True), "person_id", "id") == [("p1", "j"), ("p3", "k")]
    filled = D.merge_persons(p.withColumn("confidence", F.lit(1.0)), spark.createDataFrame([(3,)], "session_id int"))
    assert ("Unknown",) in rows(filled, "name")


def test_versions_commit_whole_or_not_at_all(spark, tmp_path):
    t = VersionedTables(spark, str(tmp_path / "v"))
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "session_id int")
    data = lambda *r: spark.createDataFrame(list(r), "session_id int, v string")
    with pytest.raises(FileNotFoundError):
        t.read("a")
    t.commit(0, keys(1, 2), a=data((1, "x"), (2, "y")), b=data((2, "z")))
    # A failure between the tables of a commit changes nothing for readers.
    broken = data((1, "new")).withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception):
        t.commit(1, keys(1), a=data((1, "new")), b=broken)
    assert rows(t.read("a")) == [(1, "x"), (2, "y")] and rows(t.read("b")) == [(2, "z")]
    t.commit(1, keys(1), a=data((1, "new")), b=data((1, "too")))
    t.commit(1, keys(1), a=data((1, "again")), b=data())  # a replay
    assert rows(t.read("a")) == [(1, "new"), (2, "y")] and rows(t.read("b")) == [(1, "too"), (2, "z")]
    D.purge_sessions(t, 2, keys(2), ["a", "b"])
    assert rows(t.read("a")) == [(1, "new")] and rows(t.read("b")) == [(1, "too")]
    before = t.commits()
    t.compact("a", "b")
    assert len(t.commits()) == 1 and rows(t.read("a")) == [(1, "new")] and rows(t.read("b")) == [(1, "too")]
    assert set(t.vacuum()) == {c[0] for c in before.values()} and rows(t.read("a")) == [(1, "new")]
    t.commit(2, keys(1), a=data(), b=data())  # replayed after the compaction
    assert rows(t.read("a")) == [(1, "new")]
    t.commit(3, keys(1), a=data((1, "last")), b=data())
    assert rows(t.read("a")) == [(1, "last")] and rows(t.read("b")) == []


def test_corrections(spark):
    e = spark.createDataFrame(
        [(1, "d1", "skill", "a", "ML", None, None, None), (1, "d1", "skill", "a2", " ml", None, None, None), (1, "d2", "skill", "b", "ml ", False, None, ["x"]), (1, "d2", "job", "j", "ML", None, None, None)],
        "session_id int, doc_id string, kind string, entity_id string, label string, user_verified boolean, user_notes string, alt_labels array<string>",
    )
    edits = spark.createDataFrame(
        [
            (1, "skill", "a", {"label": "Zeal", "user_verified": "false"}, 1), (1, "skill", "a", {"label": "Machine Learning"}, 3), (1, "skill", "a", {"user_verified": "true"}, 2),
            (1, "skill", "zz", {"user_notes": "n"}, 4), (1, "job", "j", {"label": " "}, 5), (1, "job", "j", {}, 6),
        ],
        "session_id int, kind string, entity_id string, patch map<string,string>, seq long",
    )
    out, refused = D.apply_corrections(e, edits)
    got = {r.entity_id: (r.label, r.user_verified, list(r.alt_labels)) for r in out.collect()}
    # By id, and by label in the other documents only.
    assert got == {"a": ("Machine Learning", True, ["ML"]), "a2": (" ml", None, []), "b": ("Machine Learning", True, ["x", "ml "]), "j": ("ML", None, [])}
    assert rows(refused, "entity_id", "reason") == [("j", "blank_label"), ("j", "no_fields"), ("zz", "not_found")]


def test_prompts_and_replies(spark):
    d = spark.createDataFrame([(1, "skill", '{"groups": [{"canonical": "A", "members": ["A", "a"], "reasoning": "r"}]}'), (2, "skill", "oops")], "session_id int, pool string, response string")
    assert rows(P.parse_alias_replies(d), "session_id", "canonical") == [(1, "A")]
    md = spark.createDataFrame(
        [(1, "tech_evolution", "---\nperson_name: None\n---\n\n# T\n\nbody --- more"), (1, "skill_gap", '---\ntitle: x\nperson_name: "Ann"\n---\n\nfirst'), (2, "skill_gap", "plain")],
        "session_id int, analysis_type string, markdown string",
    )
    text = {r.session_id: r.analyses for r in P.format_analyses(md).collect()}
    assert text == {1: "═══ [skill_gap] ═══\nfirst\n\n═══ [tech_evolution] ═══\n# T\n\nbody --- more", 2: "═══ [skill_gap] ═══\nplain"}
    assert rows(P.person_name_fallback(md)) == [(1, "Ann"), (2, "the candidate")]
    prompts = spark.createDataFrame([(1, "p")], "id int, prompt string")
    assert P.generate(prompts).first().response is None
    assert P.generate(prompts, lambda s: s + "!").first().response == "p!"


@pytest.mark.parametrize("reply,status", [('{"skills": [{"label": "x"}]}', "complete"), ('{"skills": []}', "empty"), ("nope", "error"), (None, "error")])
def test_parse_responses(spark, reply, status):
    df = spark.createDataFrame([("d", reply)], "doc_id string, response string")
    assert P.parse_responses(df).first().status == status


def test_gold_files_are_listed_by_folder(spark, monkeypatch):
    """A pattern that names files makes each of them a path of its own, listed one by one."""
    from careerloom.plans.queries import QUERIES, files

    paths, plain = [], files.sources.scan_gold
    monkeypatch.setattr(files.sources, "scan_gold", lambda spark, path: (paths.append(path), plain(spark, path))[1])
    assert {r["variant"] for r in QUERIES["scan_gold"](spark, "/root/testdata/sf0.001").select("variant").distinct().collect()} == {"raw", "extracted"}
    assert len(paths) == 1 and "*" not in paths[0]


def test_entities_are_read_once_many_to_a_task(spark, tmp_path):
    """Both results come from one read; a task takes files by their bytes, not 4 MB for each."""
    from careerloom.runtime import many_files

    folder = tmp_path / "sessions" / "s1" / "extracted"
    folder.mkdir(parents=True)
    for i in range(300):
        (folder / f"d{i}.json").write_text(json.dumps({"person": {"name": f"N{i}"}}) if i % 3 else "{cut off")
    plain = spark.read.text(str(folder), wholetext=True)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    with many_files(spark):
        few = spark.read.text(str(folder), wholetext=True).rdd.getNumPartitions()
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    assert few <= 8 < plain.rdd.getNumPartitions()
    good, bad = sources.scan_entities(spark, str(tmp_path / "sessions"))
    for f in folder.iterdir():
        f.unlink()
    assert good.count() == 200 and bad.count() == 100
