"""Sessions, uploads, extraction records and corrections."""

import uuid

from pyspark.sql import functions as F

from careerloom.operators import assemble as C
from careerloom.operators import sessions as D
from careerloom.operators.common import keep
from careerloom.plans.queries.registry import query
from careerloom.runtime import cut, shared_dir
from careerloom.sources import document_metadata
from careerloom.sources.versions import VersionedTables


@query(
    "document_metadata",
    """SELECT document_id, filename, lower(regexp_extract(filename, '(\\.[^.]*)$', 1)) AS extension, n_chars AS size_bytes, round_even(n_chars / 1024, 2) AS size_kb
       FROM upload JOIN documents ON doc_id = document_id""".replace("\\\\", "\\"),
)
def _(c):
    size = c.t("documents").select(F.col("doc_id").alias("document_id"), F.col("n_chars").alias("length"))
    df = c.uploads.withColumn("path", F.concat(F.lit("/data/up/"), "filename")).join(size, "document_id")
    return document_metadata(df).select("document_id", "filename", "extension", "size_bytes", "size_kb")


@query(
    "completed_entities",
    """SELECT 'src' || doc_id % 20 AS session_id, doc_id, lang FROM documents JOIN doc_status ON document_id = doc_id WHERE status = 'complete'""",
)
def _(c):
    e = c.t("documents").select(F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")).alias("session_id"), "doc_id", "lang")
    return D.completed_entities(e, c.doc_status)


@query("merge_persons", "SELECT session_id, doc_id, person_id, name, email, location FROM lead_person")
def _(c):
    return c.merged_person.select("session_id", "doc_id", "person_id", "name", "email", "location")


@query("merged_references", "SELECT session_id, person_id, kind, id FROM merged_refs")
def _(c):
    return c.merged_refs


@query(
    "duplicate_uploads",
    """SELECT session_id, document_id, filename, duplicate_of, duplicate_filename FROM (
           SELECT *, first_value(document_id) OVER w AS duplicate_of, first_value(filename) OVER w AS duplicate_filename
           FROM upload WINDOW w AS (PARTITION BY session_id, file_hash ORDER BY upload_ts, document_id)) WHERE document_id <> duplicate_of""",
)
def _(c):
    return D.duplicate_uploads(c.uploads)


@query(
    "admit_documents",
    """SELECT session_id, document_id, filename, reason IS NULL AND rk <= 10 AS accepted, CASE WHEN reason IS NOT NULL THEN reason WHEN rk > 10 THEN 'session_limit' END AS reason
       FROM (SELECT *, row_number() OVER (PARTITION BY session_id, reason IS NULL ORDER BY upload_ts, document_id) AS rk FROM (
           SELECT *, CASE WHEN row_number() OVER (PARTITION BY session_id, file_hash ORDER BY upload_ts, document_id) > 1 THEN 'duplicate'
                          WHEN filename LIKE '%.exe' THEN 'unsupported_type' END AS reason FROM upload))""",
)
def _(c):
    return D.admit_documents(c.uploads)


@query(
    "list_sessions",
    "SELECT session_id, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at, count(document_id) AS document_count FROM session LEFT JOIN doc_status USING (session_id) GROUP BY 1, 2",
)
def _(c):
    return D.list_sessions(c.session, c.doc_status).withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


@query(
    "list_sessions_top",
    "SELECT s.session_id, count(document_id) AS document_count FROM session s LEFT JOIN doc_status d ON d.session_id = s.session_id GROUP BY s.session_id, updated_at ORDER BY updated_at DESC, s.session_id LIMIT 10",
)
def _(c):
    return D.list_sessions(c.session, c.doc_status, top=10).select("session_id", "document_count")


@query(
    "storage_stats",
    """SELECT (SELECT count(*) FROM session) AS total_sessions, count(*) AS total_documents, count(*) FILTER (status = 'pending') AS pending_documents,
              count(*) FILTER (status = 'processing') AS processing_documents, count(*) FILTER (status = 'complete') AS complete_documents, count(*) FILTER (status = 'error') AS error_documents FROM doc_status""",
)
def _(c):
    return D.storage_stats(c.session, c.doc_status)


@query(
    "session_stats",
    """SELECT session_id, coalesce(n, 0) AS total_documents, coalesce(pending, 0) AS pending, coalesce(processing, 0) AS processing, coalesce(complete, 0) AS complete, coalesce(error, 0) AS error,
              CASE WHEN complete > 0 THEN coalesce(k, 0) ELSE 0 END AS skill_count,
              CASE WHEN complete > 0 THEN NULL WHEN coalesce(n, 0) = 0 THEN 'This session has no document yet: add one.' WHEN pending + processing > 0 THEN 'Documents are still being read: try again later.'
                   ELSE 'No document could be read: see the error message of each.' END AS hint
       FROM session LEFT JOIN (SELECT session_id, count(*) AS n, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing,
              count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'error') AS error FROM doc_status GROUP BY 1) USING (session_id)
       LEFT JOIN (SELECT source AS session_id, count(*) AS k FROM documents GROUP BY 1) USING (session_id)""",
)
def _(c):
    counts = c.t("documents").groupBy(F.col("source").alias("session_id")).agg(F.count("*").alias("skill_count"))
    return D.session_stats(c.session, c.doc_status, counts)


# ---------------------------------------------------------------- corrections

def _entities(c):
    return c.raw_skill.select(
        "session_id", "doc_id", F.lit("skill").alias("kind"), F.col("skill_id").alias("entity_id"), "label", "user_verified",
        F.lit(None).cast("string").alias("user_notes"), "alt_labels",
    )


def _edits(c):
    """The earliest spelling of every label is renamed; other marks get good, blank, foreign or lost edits."""
    pairs = lambda **kw: F.map_from_arrays(F.array(*[F.lit(k) for k in kw]), F.array(*kw.values()))
    row = lambda df, eid, patch, seq=2: df.select(
        "session_id", F.lit("skill").alias("kind"), eid.alias("entity_id"), patch.alias("patch"), F.lit(seq).alias("seq")
    )
    s = c.raw_skill
    first = s.filter("category = 'ECONOMY'").groupBy("session_id", F.lower("label").alias("k")).agg(F.min("skill_id").alias("skill_id"))
    rename = row(first, F.col("skill_id"), pairs(label=F.concat(F.lit("Curated "), "k"), user_verified=F.lit("true")))
    notes = row(s.filter("category = 'SMALL'"), F.col("skill_id"), pairs(user_notes=F.lit("seen")))
    # Edits that a later one of the same field overrides: greater texts, given earlier.
    taken_back = row(first, F.col("skill_id"), pairs(label=F.concat(F.lit("Zealous "), "k"), user_verified=F.lit("unclear")), 1)
    taken_back = taken_back.unionByName(row(s.filter("category = 'SMALL'"), F.col("skill_id"), pairs(user_notes=F.lit("unseen")), 1))
    blank = row(s.filter("category = 'LARGE'"), F.col("skill_id"), pairs(label=F.lit("  ")))
    alien = row(s.filter("category = 'MEDIUM'"), F.col("skill_id"), pairs(color=F.lit("red")))
    lost = row(s.filter("category = 'STANDARD'"), F.concat(F.lit("no-"), "skill_id"), pairs(label=F.lit("x")))
    return taken_back.unionByName(rename).unionByName(notes).unionByName(blank).unionByName(alien).unionByName(lost)


_FIRST = "SELECT session_id, lower(label) AS k, min(skill_id) AS skill_id FROM raw_skill WHERE category = 'ECONOMY' GROUP BY 1, 2"


@query(
    "apply_corrections",
    f"""SELECT session_id, entity_id, CASE WHEN hit THEN 'Curated ' || k ELSE label END AS label, CASE WHEN hit THEN true ELSE user_verified END AS user_verified,
               CASE WHEN noted THEN 'seen' END AS user_notes,
               array_to_string(CASE WHEN hit AND NOT list_contains(alt_labels, label) THEN list_append(alt_labels, label) ELSE alt_labels END, '|') AS alts
        FROM (SELECT s.session_id, s.skill_id AS entity_id, s.label, s.alt_labels, s.user_verified, f.k, coalesce(s.category = 'SMALL', false) AS noted,
                     f.k IS NOT NULL AND (f.skill_id = s.skill_id OR (NOT coalesce(s.category = 'SMALL', false) AND split_part(f.skill_id, ':', 1) <> s.doc_id)) AS hit
              FROM raw_skill s LEFT JOIN ({_FIRST}) f ON f.session_id = s.session_id AND f.k = lower(s.label))""",
)
def _(c):
    c.store("line", "raw_skill")
    out, _ = D.apply_corrections(_entities(c), _edits(c))
    return out.select("session_id", "entity_id", "label", "user_verified", "user_notes", F.array_join("alt_labels", "|").alias("alts"))


@query(
    "rejected_corrections",
    """SELECT session_id, 'skill' AS kind, CASE category WHEN 'STANDARD' THEN 'no-' || skill_id ELSE skill_id END AS entity_id,
              CASE category WHEN 'LARGE' THEN 'blank_label' WHEN 'MEDIUM' THEN 'unknown_field' ELSE 'not_found' END AS reason
       FROM raw_skill WHERE category IN ('LARGE', 'MEDIUM', 'STANDARD')""",
)
def _(c):
    return D.apply_corrections(_entities(c), _edits(c))[1]


# ---------------------------------------------------------------- upkeep

_GRAPH_TS = "SELECT session_id, max(ts) AS graph_ts FROM event WHERE event = 'started' GROUP BY 1"


def _graph_ts(c):
    return c.events.filter("event = 'started'").groupBy("session_id").agg(F.max("ts").alias("graph_ts"))


@query(
    "stale_sessions",
    f"""SELECT session_id, strftime(e, '%Y-%m-%d %H:%M:%S') AS entity_ts, strftime(graph_ts, '%Y-%m-%d %H:%M:%S') AS graph_ts
        FROM (SELECT session_id, max(last_ts) AS e FROM doc_status WHERE status = 'complete' GROUP BY 1) LEFT JOIN ({_GRAPH_TS}) USING (session_id)
        WHERE graph_ts IS NULL OR e > graph_ts""",
)
def _(c):
    out = D.stale_sessions(c.doc_status.withColumn("entity_ts", F.col("last_ts")), _graph_ts(c))
    text = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss").alias(x)
    return out.select("session_id", text("entity_ts"), text("graph_ts"))


_KIND = "CASE event WHEN 'started' THEN 'skill_gap' WHEN 'progress' THEN 'career_topology' WHEN 'complete' THEN 'conservative' ELSE 'tech_evolution' END"
_WANTED = """(SELECT unnest(['skill_gap', 'career_topology', 'tech_evolution', 'hierarchy_map', 'esco_coverage', 'role_progression']) AS analysis_type, 'analysis' AS family
    UNION ALL SELECT unnest(['conservative', 'exploratory']), 'narrative')"""


def _insights(c):
    kind = (
        F.when(F.col("event") == "started", "skill_gap").when(F.col("event") == "progress", "career_topology")
        .when(F.col("event") == "complete", "conservative").otherwise("tech_evolution")
    )
    return c.events.groupBy("session_id", kind.alias("analysis_type")).agg(F.max("payload").alias("content"))


@query(
    "insight_status",
    f"""SELECT s.session_id, family, w.analysis_type, content IS NOT NULL AS available, content FROM session s CROSS JOIN {_WANTED} w
        LEFT JOIN (SELECT session_id, {_KIND} AS analysis_type, max(payload) AS content FROM event GROUP BY 1, 2) i ON i.session_id = s.session_id AND i.analysis_type = w.analysis_type""",
)
def _(c):
    return D.insight_status(c.session, _insights(c))


@query(
    "insight_totals",
    """SELECT session_id, CASE WHEN session_id LIKE 'src%' THEN 3 ELSE 0 END AS insights_available, 6 AS insights_total, session_id LIKE 'src%' AS narratives_conservative, false AS narratives_exploratory FROM session""",
)
def _(c):
    return D.insight_totals(D.insight_status(c.session, _insights(c)))


@query(
    "inspect_documents",
    """SELECT d.session_id, d.doc_id, coalesce(j.n, 0) AS n_jobs, coalesce(array_to_string(j.l[1:5], '; ') || CASE WHEN j.n > 5 THEN '; +' || (j.n - 5) || ' more' ELSE '' END, '') AS jobs,
              coalesce(s.n, 0) AS n_skills, coalesce(array_to_string(s.l[1:10], '; ') || CASE WHEN s.n > 10 THEN '; +' || (s.n - 10) || ' more' ELSE '' END, '') AS skills
       FROM doc d LEFT JOIN (SELECT session_id, doc_id, count(*) AS n, list(title || ' at ' || coalesce(org_id, 'N/A') ORDER BY pos, job_id) AS l FROM job GROUP BY 1, 2) j ON j.doc_id = d.doc_id
       LEFT JOIN (SELECT session_id, doc_id, count(*) AS n, list(label ORDER BY label, skill_id) AS l FROM raw_skill GROUP BY 1, 2) s ON s.doc_id = d.doc_id""",
)
def _(c):
    return D.inspect_documents(c.docs, c.job, c.raw_skill)


@query("latest_session", "SELECT session_id, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at FROM session ORDER BY session.updated_at DESC, session_id DESC LIMIT 1")
def _(c):
    return D.latest_session(c.session).select("session_id", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


_BIG = "SELECT session_id FROM job GROUP BY 1 HAVING count(*) > 12"
_SOURCES = {
    "jobs": ("job", "job_id"), "skills": ("raw_skill", "skill_id"), "education": ("raw_edu", "edu_id"), "certifications": ("raw_cert", "cert_id"),
    "organizations": ("raw_org", "org_id"), "persons": ("raw_person", "person_id"), "documents": ("doc", "doc_id"),
}


@query(
    "purge_sessions",
    " UNION ALL ".join(
        f"SELECT '{part}' AS part, session_id, CAST({c} AS VARCHAR) AS id FROM {block} WHERE session_id NOT IN ({_BIG})" for part, (block, c) in _SOURCES.items()
    ),
)
def _(c):
    """All entity tables and the index of documents, stored in versions; a purge, then a compaction that applies it."""
    frames = {"job": c.job, "raw_skill": c.raw_skill, "raw_edu": c.raw_edu, "raw_cert": c.raw_cert, "raw_org": c.raw_org, "raw_person": c.raw_person, "doc": c.docs}
    parts = {part: cut(frames[block].select("session_id", F.col(col).alias("id"))) for part, (block, col) in _SOURCES.items()}
    tables = VersionedTables(c.spark, f"{shared_dir(c.spark)}/sessions-{uuid.uuid4().hex}")
    tables.commit(0, c.docs.select("session_id"), **parts)
    big = c.job.groupBy("session_id").agg(F.count("*").alias("n")).filter("n > 12")
    D.purge_sessions(tables, 1, big, list(parts))
    tables.compact(*parts)
    out = None
    for part in parts:
        rows = tables.read(part).select(F.lit(part).alias("part"), "session_id", "id")
        out = rows if out is None else out.unionByName(rows)
    return out


# ---------------------------------------------------------------- extraction records

def records(c):
    """Extraction records, one per document: the nested shape a model returns."""
    from careerloom.schemas import ENTITY_RECORD

    c.store("line", "job", "raw_org", "raw_edu")
    jobs = c.job.select(
        "session_id", "doc_id", "job_id", "title", F.col("start_date").cast("string").alias("start_date"),
        F.date_format("end_date", "yyyy-MM").alias("end_date"), "is_current", "achievements", "org_id", "pos",
    )
    names = c.line.filter("flag <> 'R'").groupBy("session_id", "job_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("flag") == "A", F.col("raw_label")))).alias("skills_used"),
        F.array_sort(F.collect_set(F.when(F.col("flag") == "N", F.col("raw_label")))).alias("technologies_used"),
    )
    firms = c.raw_org.select("session_id", "doc_id", "org_id", F.col("name").alias("company"))
    # A third of the jobs name the company, a third give an id, a third both.
    style = F.col("pos") % 3
    job = F.struct(
        "pos", "title",
        F.when(style != 1, F.col("company")).alias("company"), F.when(style != 0, F.col("org_id")).alias("organization_id"),
        "start_date", "end_date", "is_current", "skills_used", "technologies_used", "achievements",
    )
    j = (
        jobs.join(names, ["session_id", "job_id"], "left").join(firms, ["session_id", "doc_id", "org_id"], "left")
        .groupBy("session_id", "doc_id").agg(F.array_sort(F.collect_list(job)).alias("jobs"))
    )
    sk = (
        c.raw_skill.filter("declared")
        .groupBy("session_id", "doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("label", "category", "proficiency_level", "years_experience", "confidence"))).alias("skills"))
    )
    og = c.raw_org.filter("pos % 2 = 0").groupBy("session_id", "doc_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.col("org_id").alias("id"), "name", "org_type"))).alias("organizations")
    )
    ed = c.raw_edu.select("session_id", "doc_id", F.array(F.struct("degree_type", "field_of_study", "institution_id")).alias("education"))
    ce = c.raw_cert.groupBy("session_id", "doc_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "name", "issuing_organization", F.col("issue_date").cast("string").alias("issue_date"), F.date_format("expiration_date", "yyyy").alias("expiration_date")))).alias("certifications")
    )
    pe = c.raw_person.select("session_id", "doc_id", F.struct("name", "email", "location").alias("person"))
    # A document is one of its session, and so everything lies where its session does.
    wide = j
    for block in (sk, og, ed, ce, pe):
        wide = wide.join(block, ["session_id", "doc_id"], "left")
    parts = {}
    for f in ENTITY_RECORD.fields:
        if f.name in wide.columns:
            parts[f.name] = F.from_json(F.to_json(F.struct(F.col(f.name).alias("v"))), f"struct<v:{f.dataType.simpleString()}>").getField("v")
    out = wide.select("session_id", "doc_id", F.concat("doc_id", F.lit(".txt")).alias("source_doc"), *[v.alias(k) for k, v in parts.items()])
    return keep(out, c.buckets)


@query(
    "build_skills",
    "SELECT session_id, doc_id, label, category, proficiency_level, years_experience, confidence FROM raw_skill WHERE declared",
)
def _(c):
    return C.build_skills(records(c)).select("session_id", "doc_id", "label", "category", "proficiency_level", "years_experience", "confidence")


@query(
    "resolve_skill_names",
    """SELECT u.session_id, u.doc_id, u.job_id, u.kind, u.label, CASE WHEN s.label IS NULL THEN 'Technical' ELSE s.category END AS category, s.label IS NULL AS created
       FROM (SELECT DISTINCT session_id, doc_id, job_id, CASE flag WHEN 'A' THEN 'skill' ELSE 'technology' END AS kind, raw_label AS label FROM line WHERE flag <> 'R') u
       LEFT JOIN (SELECT doc_id, label, category FROM raw_skill WHERE declared) s ON s.doc_id = u.doc_id AND s.label = u.label""",
)
def _(c):
    raw = records(c)
    declared = C.build_skills(raw)
    bridge, created = C.resolve_skill_names(C.job_skill_names(raw), declared)
    every = declared.select("doc_id", "skill_id", "label", "category", F.lit(False).alias("created")).unionByName(
        created.select("doc_id", "skill_id", "label", "category", F.lit(True).alias("created"))
    )
    # The position of the record stands for the job; name the job itself.
    jobs = raw.select("doc_id", F.posexplode("jobs").alias("pos", "r")).select(
        "doc_id", F.concat_ws(":", "doc_id", F.lit("job"), F.col("pos").cast("string")).alias("job_id"), F.col("r.title").alias("title"), F.col("r.start_date").alias("start")
    )
    own = c.job.select("doc_id", F.col("job_id").alias("own"), F.row_number().over(_in_doc()).alias("n"))
    keyed = jobs.withColumn("n", F.substring_index("job_id", ":", -1).cast("int") + 1).join(own, ["doc_id", "n"])
    return (
        bridge.join(every, ["doc_id", "skill_id"])
        .join(keyed.select("doc_id", "job_id", "own"), ["doc_id", "job_id"])
        .select("session_id", "doc_id", F.col("own").alias("job_id"), "kind", "label", "category", "created")
    )


def _in_doc():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id").orderBy("pos")


@query(
    "register_orgs",
    """SELECT session_id, doc_id, doc_id || '.txt' AS source_doc, org_id, name, org_type, CAST(NULL AS VARCHAR) AS location, CAST(NULL AS VARCHAR) AS website,
              CAST(NULL AS VARCHAR) AS description, CAST(1.0 AS DOUBLE) AS confidence, CAST(rank AS INTEGER) AS pos FROM registered""",
)
def _(c):
    return C.register_orgs(records(c))[0]


@query(
    "build_jobs",
    """SELECT session_id, j.doc_id, pos, title, start_date, end_date, is_current, n_achievements, coalesce(o.org_id, '') AS org_id FROM (
           SELECT session_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, title, strftime(start_date, '%Y-%m-%d') AS start_date,
                  strftime(date_trunc('month', end_date), '%Y-%m-%d') AS end_date, is_current, len(achievements) AS n_achievements FROM job) j
       LEFT JOIN mention_org o ON o.doc_id = j.doc_id AND o.src = 1 AND o.nr = pos""",
)
def _(c):
    raw = records(c)
    out = C.build_jobs(raw, C.register_orgs(raw)[1])
    return out.select(
        "session_id", "doc_id", F.col("pos").cast("long"), "title", F.col("start_date").cast("string"), F.col("end_date").cast("string"), "is_current",
        F.size("achievements").cast("long").alias("n_achievements"), "org_id",
    )


@query(
    "build_education",
    """SELECT session_id, e.doc_id, degree_type || ' in ' || field_of_study AS label, degree_type, field_of_study, o.org_id AS institution_id
       FROM raw_edu e LEFT JOIN mention_org o ON o.doc_id = e.doc_id AND o.src = 2""",
)
def _(c):
    raw = records(c)
    orgs, mentions = C.register_orgs(raw)
    return C.build_education(raw, mentions, orgs).select("session_id", "doc_id", "label", "degree_type", "field_of_study", "institution_id")


@query(
    "build_certifications",
    """SELECT session_id, doc_id, name, issuing_organization, strftime(issue_date, '%Y-%m-%d') AS issue_date, year(expiration_date) || '-01-01' AS expiration_date, true AS is_active FROM raw_cert""",
)
def _(c):
    return C.build_certifications(records(c)).select(
        "session_id", "doc_id", "name", "issuing_organization", F.col("issue_date").cast("string"), F.col("expiration_date").cast("string"), "is_active"
    )


@query("build_person", "SELECT session_id, doc_id, name, email, location FROM raw_person")
def _(c):
    return C.build_person(records(c)).select("session_id", "doc_id", "name", "email", "location")


@query(
    "person_references",
    """SELECT session_id, doc_id, kind, count(*) AS n FROM (
           SELECT session_id, doc_id, 'job' AS kind, job_id AS id FROM job UNION ALL SELECT session_id, doc_id, 'education', edu_id FROM raw_edu
           UNION ALL SELECT session_id, doc_id, 'certification', cert_id FROM raw_cert
           UNION ALL SELECT session_id, doc_id, 'skill', raw_label FROM (SELECT DISTINCT session_id, doc_id, raw_label FROM line)) GROUP BY 1, 2, 3""",
)
def _(c):
    return C.assemble(records(c))["person_refs"].groupBy("session_id", "doc_id", "kind").agg(F.count("*").alias("n"))


@query(
    "empty_extraction_flag",
    "SELECT source, count(*) AS n, count(*) FILTER (lang NOT IN ('en', 'fr')) AS n_empty FROM documents GROUP BY 1",
)
def _(c):
    from careerloom.plans import prompts as P

    lang = F.col("lang")
    reply = F.when(lang == "en", F.lit('{"skills": [{"label": "x"}]}')).when(lang == "fr", F.lit('{"person": {"name": "y"}}')).otherwise(F.lit('{"jobs": []}'))
    out = P.parse_responses(c.t("documents").select("doc_id", "source", reply.alias("response")))
    return out.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "empty").alias("n_empty"))


@query(
    "entity_counts",
    """SELECT session_id, doc_id, count(*) FILTER (kind = 'person') AS person_count, count(*) FILTER (kind = 'job') AS job_count, count(*) FILTER (kind = 'skill') AS skill_count,
              count(*) FILTER (kind = 'education') AS education_count, count(*) FILTER (kind = 'certification') AS certification_count, count(*) FILTER (kind = 'organization') AS organization_count, count(*) AS total
       FROM (SELECT session_id, doc_id, 'person' AS kind FROM raw_person UNION ALL SELECT session_id, doc_id, 'job' FROM job UNION ALL SELECT session_id, doc_id, 'skill' FROM raw_skill
             UNION ALL SELECT session_id, doc_id, 'education' FROM raw_edu UNION ALL SELECT session_id, doc_id, 'certification' FROM raw_cert UNION ALL SELECT session_id, doc_id, 'organization' FROM raw_org)
       GROUP BY 1, 2""",
)
def _(c):
    part = lambda df, kind: df.select("session_id", "doc_id", F.lit(kind).alias("kind"))
    rows = (
        part(c.raw_person, "person").unionByName(part(c.job, "job")).unionByName(part(c.raw_skill, "skill"))
        .unionByName(part(c.raw_edu, "education")).unionByName(part(c.raw_cert, "certification")).unionByName(part(c.raw_org, "organization"))
    )
    return C.entity_counts(rows)
