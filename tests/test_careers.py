"""Analyses, reports and streams on tiny careers."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from careerloom import vocab as V
from careerloom.operators import analyze as A
from careerloom.operators import evaluate as K
from careerloom.operators import taxonomy as J
from careerloom.plans import insights as I
from careerloom.plans import render as R
from careerloom.plans import texts as TX
from careerloom.streaming import feeds, status


@pytest.fixture(scope="module")
def frames(spark):
    jobs = spark.createDataFrame(
        [
            (1, "j1", "Dev", dt.date(2018, 1, 1), dt.date(2019, 1, 1), False, "o", ["Built it", "Ran it", "Sold it"]),
            (1, "j2", "Dev", dt.date(2019, 2, 1), None, True, "o", None),
            (1, "j0", "Intern", None, None, False, None, []),
        ],
        "session_id int, job_id string, title string, start_date date, end_date date, is_current boolean, org_id string, achievements array<string>",
    )
    skills = spark.createDataFrame(
        [
            (1, "s1", "Python", "Technical", "Expert", "urn:py", ["programming"], []), (1, "s2", "Cooking", None, None, None, [], []), (1, "s3", " ", None, None, None, [], []),
        ],
        "session_id int, skill_id string, label string, category string, proficiency_level string, skos_uri string, broader_concepts array<string>, narrower_concepts array<string>",
    )
    refs = spark.createDataFrame(
        # Each technology is named twice, as IRI and as literal; that is still one use.
        [(1, "j1", V.RES + "s1"), (1, "j1", "Python"), (1, "j1", "s1"), (1, "j2", "python"), (1, "j2", "SQL"), (1, "j1", V.RES + "gone")],
        "session_id int, job_id string, ref string",
    )
    persons = spark.createDataFrame([(1, "Ann Lee", "a.md"), (2, "Bob", "b.md")], "session_id int, person_name string, source_document string")
    matches = spark.createDataFrame([("python", "urn:py", "python", "coding")], "label_key string, concept_uri string, preferred_label string, broader_label string")
    return {
        "persons": persons, "jobs": jobs, "skills": skills, "tech": A.resolve_tech(refs, skills), "matches": matches,
        "nodes": jobs.select("session_id", F.col("job_id").alias("id")),
    }


def test_technology_counts_once_per_job(frames):
    assert rows(frames["tech"], "job_id", "tech_key") == [("j1", "python"), ("j2", "python"), ("j2", "sql")]
    assert rows(A.technology_spread(frames["tech"]), "tech_key", "n_jobs", "role") == [("python", 2, "bridge"), ("sql", 1, "island")]
    assert rows(A.isolated_roles(frames["tech"], frames["jobs"]), "job_id") == [("j0",)]
    # Two jobs of one title connect to each other, not to themselves.
    assert rows(A.role_connections(frames["tech"], frames["jobs"]), "job_id", "other_title") == [("j1", "Dev"), ("j2", "Dev")]


def test_gap_skips_blank_labels(frames):
    s = A.skill_gap_summary(A.skill_gap(frames["skills"], frames["tech"])).first()
    assert (s.claimed_count, s.used_count, s.overlap_count) == (2, 2, 1)


def test_missing_start_sorts_first(frames):
    assert rows(A.tech_timeline(frames["jobs"], frames["tech"]), "pos", "job_id", "period") == [
        (1, "j0", "? – present"), (2, "j1", "2018-01-01 – 2019-01-01"), (3, "j2", "2019-02-01 – present")
    ]
    assert rows(A.tech_transitions(frames["jobs"], frames["tech"]), "to_job", "tech_key", "change") == [
        ("j1", "python", "gained"), ("j2", "python", "retained"), ("j2", "sql", "gained")
    ]


def test_battery_texts(frames):
    docs, failed = I.run_battery(frames, F.lit("2024-01-01"))
    assert failed == {}
    text = {(r.session_id, r.analysis_type): r.content for r in docs.collect()}
    assert len(text) == 12
    gap = text[1, "skill_gap"]
    assert gap.startswith("Ann's resume declares **2 skills**") and "(Python)" in gap
    assert gap.endswith("- **Cooking** — ?, unrated") and "**Dev (2019-02-01–present)**\n- SQL\n" in gap
    prog = text[1, "role_progression"]
    assert "### Dev (2018-01-01 – 2019-01-01)\n- Built it\n- Ran it\n\n" in prog and "Sold it" not in prog
    assert "### Dev (2019-02-01 – present) ← **CURRENT**" in prog and "**1 organization(s)**" in prog
    # A person without jobs gets a text too.
    assert text[2, "role_progression"].startswith("Bob's graph lists no roles yet.")
    assert text[1, "esco_coverage"].startswith("**50%** of Ann's skills (**1/2**)")
    assert "- **Python** → falls under: programming" in text[1, "hierarchy_map"]
    md = I.to_markdown(docs.filter("analysis_type = 'skill_gap' and session_id = 1")).first().markdown
    assert md.startswith('---\nanalysis_type: skill_gap\ntitle: "') and '\n  - "skills"\n' in md and "\njob_count: 3\n" in md
    ids = rows(I.retrieval_entries(docs), "id")
    assert ("1:skill_gap",) in ids and ("2:skill_gap",) in ids


def test_registered_analyzer(frames):
    I.register_analyzer("roll_call", "Roll call", ("names",), ("who",), lambda f: R.lines(f["persons"], 0, F.col("person_name")))
    try:
        docs, _ = I.run_battery(frames, F.lit("2024-01-01"), ["roll_call"])
        assert rows(docs, "title", "content") == [("Roll call", "Ann Lee"), ("Roll call", "Bob")]
    finally:
        del I.ANALYZERS["roll_call"], TX.INSIGHTS["roll_call"]


def test_link_taxonomy(spark):
    df = spark.createDataFrame(
        [("a", "Python", None, [], []), ("b", "Programming", "urn:mine", [], []), ("c", "Data Science", None, ["own"], [])],
        "skill_id string, label string, skos_uri string, broader_concepts array<string>, narrower_concepts array<string>",
    )
    uris = spark.createDataFrame([("python", "urn:py"), ("programming", "urn:x")], "taxonomy_key string, uri string")
    got = {r.skill_id: (r.skos_uri, r.broader_concepts, len(r.narrower_concepts)) for r in J.link_taxonomy(df, uris, J.category_table(spark)).collect()}
    assert got == {"a": ("urn:py", [], 0), "b": ("urn:mine", ["technical"], 5), "c": (None, ["own"], 0)}
    inv = {r.skill_id: r.broader_concepts for r in J.link_taxonomy(df, uris, J.category_table(spark), inverse=True).collect()}
    assert inv == {"a": ["programming"], "b": ["technical"], "c": ["own"]}


def test_match_candidates_equals_brute_force(spark):
    titles = ["manage data", "data mining", "python (programming)", "program in python", "go", "web design", "de"]
    labels = ["Data", "python", "go", "web stuff", "x", "de", "zzz", "data mining", "sign"]
    tax = spark.createDataFrame([(f"u{i}", t) for i, t in enumerate(titles)], "concept_uri string, pref_label string")
    got = set(rows(J.match_candidates(spark.createDataFrame([(x,) for x in labels], "label string"), tax, None), "label", "pref_label", "score"))

    def score(lab, title):
        lab = lab.lower()
        if len(lab) < 2:
            return 0
        return 3 if title.startswith(lab) else 2 if lab in title else 1 if lab.split()[0] == title.split()[0] else 0

    assert got == {(a, b, score(a, b)) for a in labels for b in titles if score(a, b)}


def test_eval_report_and_person(spark):
    detail = spark.createDataFrame(
        [("d", "skills", "sql", "matched"), ("d", "skills", "ml", "missing"), ("d", "jobs", "dev", "unexpected")], "doc_id string, etype string, key string, status string"
    )
    report = K.render_eval_report(detail).first().report.split("\n")
    assert report[0] == f"{'type':<15} {'P':>6} {'R':>6} {'F1':>6}   matched / missing / unexpected" and report[1] == "-" * 72
    assert report[2] == f"{'jobs':<15} {0:>6.2f} {0:>6.2f} {0:>6.2f}   0 / 0 / 1"
    assert report[3] == f"{'skills':<15} {1:>6.2f} {0.5:>6.2f} {0.667:>6.2f}   1 / 1 / 0"
    assert report[5] == f"{'TOTAL':<15} {0.5:>6.2f} {0.5:>6.2f} {0.5:>6.2f}   1 / 1 / 1"
    assert report[6:] == ["  unexpected jobs: dev", "  missing skills: ml"]
    lines = [r.line for r in K.render_batch_lines(detail).orderBy("sec", "ord").collect()]
    assert lines[0] == "Batch evaluation — 1 documents evaluated" and "  ml (skills) — 1 documents" in lines
    got = spark.createDataFrame([("a", "ANN  lee"), ("b", "Bob")], "doc_id string, name string")
    gold = spark.createDataFrame([("a", "Ann Lee"), ("b", ""), ("c", "Cy")], "doc_id string, name string")
    assert rows(K.eval_person(got, gold), "doc_id", "key", "status") == [("a", "ann lee", "matched"), ("c", "cy", "missing")]


def test_totals_are_sums(spark):
    detail = spark.createDataFrame(
        [("a", "skills", "x", "matched"), ("a", "jobs", "y", "missing"), ("b", "skills", "z", "unexpected")], "doc_id string, etype string, key string, status string"
    )
    t = {(r.level, r.doc_id, r.etype): r for r in K.eval_by_type(detail).collect()}
    assert t[3, None, None].matched == 1 and t[3, None, None].missing == 1 and t[3, None, None].unexpected == 1
    assert sum(r.matched + r.missing + r.unexpected for (lvl, *_), r in t.items() if lvl == 0) == 3


EVENTS = "event_id long, ts timestamp, session_id string, document_id long, event string, payload string"


def test_streams_equal_batch_and_survive_restart(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    kinds = ["started", "progress", "entity_extracted", "complete", "error"]
    data = [(i, t0 + dt.timedelta(minutes=7 * i), f"s{i % 2}", i % 6, kinds[(i * 7) % 5], str(i % 9)) for i in range(120)]
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    df = spark.createDataFrame(data, EVENTS)

    def stream():
        return spark.readStream.schema(EVENTS).parquet(src)

    want = status.document_runs(df, "3 hours")
    for part in (df.filter("event_id < 40"), df.filter("event_id between 40 and 79"), df.filter("event_id >= 80")):
        part.write.mode("append").parquet(src)
        status.stream_document_status(stream(), out, ckpt, keep=dt.timedelta(hours=3)).awaitTermination()
    assert rows(status.current_status(spark, out)) == rows(want)
    by_session = {r.session_id: (r.documents, r.updated_at) for r in status.session_changes(want).collect()}
    assert by_session == {"s0": (3, t0 + dt.timedelta(minutes=7 * 118)), "s1": (3, t0 + dt.timedelta(minutes=7 * 119))}

    feeds.stream_dedup_uploads(
        stream().select("session_id", F.md5("payload").alias("file_hash"), F.col("ts").alias("upload_ts"), F.col("event_id").alias("document_id")), out + "2", ckpt + "2"
    ).awaitTermination()
    assert feeds.first_uploads(spark, out + "2").count() == df.select("session_id", "payload").distinct().count()

    feeds.stream_event_counts(stream(), out + "3", ckpt + "3").awaitTermination()
    got, all_windows = rows(spark.read.parquet(out + "3")), rows(feeds.event_counts(df, delay=None))
    assert got and set(got) < set(all_windows)  # windows behind the watermark only
    assert max(r[3] for r in got) <= 6 and any(r[1] == "error" for r in got)

    # Each batch rebuilds its sessions whole; the newest committed version counts.
    current = feeds.document_status(df)

    def rebuild(touched):
        return {"triples": current.join(touched, "session_id", "left_semi").select("session_id", "document_id", "status")}

    done = stream().filter("event = 'complete'")
    for _ in range(2):
        feeds.stream_rebuild(done, rebuild, out + "4", ckpt + "4", completed=lambda: current.filter("status = 'complete'")).awaitTermination()
    ready = [r.session_id for r in current.filter("status = 'complete'").groupBy("session_id").count().filter("count >= 2").collect()]
    assert rows(feeds.latest_rows(spark, out + "4")) == rows(current.filter(F.col("session_id").isin(ready)).select("session_id", "document_id", "status"))


def test_a_finished_document_keeps_no_state(spark, tmp_path):
    """One unfinished document, many finished ones and later events: the state that is left is of the last batch's day."""
    t0 = dt.datetime(2024, 1, 1)
    data = [(0, t0, "s", 0, "started", None)] + [(i, t0 + dt.timedelta(hours=i), "s", i, "complete", None) for i in range(1, 200)]
    df, src = spark.createDataFrame(data, EVENTS), str(tmp_path / "in")
    for low in (0, 100):
        df.filter((F.col("event_id") >= low) & (F.col("event_id") < low + 100)).coalesce(1).write.mode("append").parquet(src)
        q = status.stream_document_status(spark.readStream.schema(EVENTS).parquet(src), str(tmp_path / "out"), str(tmp_path / "ckpt"), keep=dt.timedelta(hours=5))
        q.awaitTermination()
    kept = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert kept < 60  # of 200 documents; timers count as rows
    assert status.current_status(spark, str(tmp_path / "out")).count() == 200


def test_filters_name_the_batches_that_may_hold_a_key(spark, tmp_path):
    batches = [[(f"s{i % 3}", f"h{b}-{i}", b * 100 + i, i) for i in range(50)] for b in range(4)]
    batches[3] += [("s0", "h1-0", 999, 1), ("s1", "new", 5, 2), ("s1", "new", 5, 1)]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows_ in batches:
        spark.createDataFrame(rows_, "session_id string, file_hash string, upload_ts long, document_id long").coalesce(1).write.mode("append").parquet(src)
        schema = "session_id string, file_hash string, upload_ts long, document_id long"
        feeds.stream_dedup_uploads(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "ckpt")).awaitTermination()
    kept = {(r.session_id, r.file_hash): (r.upload_ts, r.document_id) for r in feeds.first_uploads(spark, out).collect()}
    assert len(kept) == 201 and kept["s0", "h1-0"] == (100, 0) and kept["s1", "new"] == (5, 1)
    commits = feeds.VersionedTables(spark, out, ("session_id", "file_hash")).commits()
    asked = spark.createDataFrame([("s0", "h1-0"), ("s2", "h2-2")], "session_id string, file_hash string")
    found = feeds.may_hold(spark, out, commits, asked.select(F.xxhash64("session_id", "file_hash").alias("k")))
    assert {1, 2} <= set(found)


def test_a_failing_analysis_leaves_the_others(spark, frames, monkeypatch):
    def breaks(f):
        return I.ANALYZERS["esco_coverage"](f).withColumn("line", F.raise_error(F.lit("no")).cast("string"))

    monkeypatch.setitem(I.ANALYZERS, "skill_gap", breaks)
    docs, failed = I.run_battery(frames, F.lit("2024-01-01"))
    assert list(failed) == ["skill_gap"]
    assert {r.analysis_type for r in docs.collect()} == set(I.ANALYZERS) - {"skill_gap"}
