"""Scoring against gold labels: flags A and R are gold, N and R extracted."""

from pyspark.sql import functions as F

from careerloom.functions.text import EMAIL_PATTERN, SECRET_PATTERNS
from careerloom.operators import evaluate as K
from careerloom.operators import view
from careerloom.plans.queries.registry import query

_FIELDS = ("label", "name", "title", "degree_type", "field_of_study", "text")


def _item(df, etype, **cols):
    fill = {c: cols.get(c, F.lit(None)) for c in _FIELDS}
    return df.select(F.col("session_id").alias("doc_id"), F.lit(etype).alias("etype"), *[v.cast("string").alias(k) for k, v in fill.items()])


def _items(c, flags, status, third):
    """Skills as structs where the name starts with a vowel sound, bare strings elsewhere; the other types as structs."""
    lines = c.line.filter(F.col("flag").isin(*flags))
    struct = F.col("variant") == 0
    label = F.when(struct, F.concat(F.lit(" "), F.upper("p_name")))
    jobs = c.job.filter(F.col("status") != status)
    some = lambda df, n: df.filter(F.col(n) % 3 != third)
    return (
        _item(lines, "skills", label=label, text=F.when(~struct, F.col("p_name")))
        .unionByName(_item(jobs, "jobs", title=F.col("title")))
        .unionByName(_item(some(c.raw_edu, "session_id"), "education", degree_type=F.col("degree_type"), field_of_study=F.col("field_of_study")))
        .unionByName(_item(some(c.raw_cert, "pos"), "certifications", name=F.col("name")))
        .unionByName(_item(some(c.raw_org, "pos"), "organizations", name=F.col("name")))
    )


def _keys(c):
    return K.eval_keys(_items(c, ("N", "R"), "O", 0)), K.eval_keys(_items(c, ("A", "R"), "P", 1))


def _detail(c):
    return K.eval_detail(*_keys(c))


@query("eval_keys", "SELECT doc_id, etype, key, 'got' AS side FROM got UNION ALL SELECT doc_id, etype, key, 'want' FROM want")
def _(c):
    got, want = _keys(c)
    return got.withColumn("side", F.lit("got")).unionByName(want.withColumn("side", F.lit("want")))


@query(
    "eval_keys_education",
    """SELECT DISTINCT session_id AS doc_id, 'education' AS etype, lower(degree_type) || '|' || lower(field_of_study) AS key FROM raw_edu
       UNION SELECT session_id, 'certifications', lower(name) FROM raw_cert
       UNION SELECT session_id, 'organizations', regexp_replace(trim(regexp_replace(lower(name), '[,.]?\\s*(inc|llc|ltd|corp|co)\\.?$', ''), ' ,.'), '^the ', '') FROM raw_org""".replace("\\\\", "\\"),
)
def _(c):
    items = (
        _item(c.raw_edu, "education", degree_type=F.col("degree_type"), field_of_study=F.col("field_of_study"))
        .unionByName(_item(c.raw_cert, "certifications", name=F.col("name")))
        .unionByName(_item(c.raw_org, "organizations", name=F.col("name")))
    )
    return K.eval_keys(items)


@query("eval_detail", "SELECT doc_id, etype, key, status FROM detail")
def _(c):
    return _detail(c)


def _prf_sql(cols: str, source: str, group: str) -> str:
    return f"""SELECT *, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM (
        SELECT *, round(p, 6) AS precision, round(r, 6) AS recall FROM (
        SELECT *, CASE WHEN matched + unexpected > 0 THEN matched / (matched + unexpected) ELSE 0.0 END AS p,
                  CASE WHEN matched + missing > 0 THEN matched / (matched + missing) ELSE 0.0 END AS r FROM (
        SELECT {cols}, count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'missing') AS missing,
               count(*) FILTER (status = 'unexpected') AS unexpected FROM {source} GROUP BY {group})))""".replace(
        "SELECT *, round(CASE", "SELECT * EXCLUDE (p, r), round(CASE", 1
    )


@query("eval_by_type", _prf_sql("doc_id, etype, CAST(grouping(doc_id, etype) AS INTEGER) AS level", "detail", "ROLLUP (doc_id, etype)"))
def _(c):
    return K.eval_by_type(_detail(c))


@query("eval_totals", _prf_sql("doc_id", "detail", "doc_id"))
def _(c):
    return K.eval_totals(_detail(c))


@query("eval_micro", _prf_sql("etype", "detail", "ROLLUP (etype)"))
def _(c):
    return K.eval_micro(_detail(c))


@query(
    "eval_person",
    """SELECT doc_id, 'person' AS etype, key, status FROM (
           SELECT c_custkey AS doc_id, lower(c_name) AS key, CASE WHEN c_custkey % 3 = 0 THEN 'missing' ELSE 'matched' END AS status FROM customer
           UNION ALL SELECT c_custkey, lower(c_name) || ' jr', 'unexpected' FROM customer WHERE c_custkey % 3 = 0)""",
)
def _(c):
    cust = c.t("customer")
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit("  Jr"))).otherwise(F.upper("c_name"))
    got = cust.select(F.col("c_custkey").alias("doc_id"), name.alias("name"))
    return K.eval_person(got, cust.select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("name")))


@query(
    "ranked_errors",
    """SELECT status, etype, key, n_docs, CAST(rk AS INTEGER) AS rk FROM (
           SELECT *, row_number() OVER (PARTITION BY status ORDER BY n_docs DESC, etype, key) AS rk FROM (
               SELECT status, etype, key, count(*) AS n_docs FROM detail WHERE status <> 'matched' GROUP BY 1, 2, 3)) WHERE rk <= 10""",
)
def _(c):
    return K.ranked_errors(_detail(c))


@query("has_discrepancies", "SELECT bool_or(status <> 'matched') AS has_discrepancies FROM detail")
def _(c):
    return K.has_discrepancies(_detail(c))


@query(
    "select_gold",
    """SELECT CAST(d.doc_id AS VARCHAR) AS id, 'normalized' AS mode,
              CASE WHEN lang <> 'en' THEN 'no normalized gold file (raw-only fixture)' WHEN quality IS NULL OR quality = 0 THEN 'missing gold file: ' || d.doc_id
                   WHEN toxic = 1 THEN 'missing extraction output: ' || d.doc_id END AS skipped
       FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def _(c):
    sid = F.col("doc_id").cast("string").alias("id")
    manifest = c.t("documents").select(sid, (F.col("lang") == "en").alias("has_normalized_expected"))
    labels = c.t("labels")
    gold = labels.filter("quality = 1").select(sid, F.lit("normalized").alias("variant"))
    return K.select_gold(manifest, gold, labels.filter("toxic = 0").select(sid), "normalized")


@query(
    "threshold_check",
    """SELECT c_custkey AS doc_id, coalesce(sm / nullif(sm + sx, 0), 1.0) >= 0.8 AS skill_recall_ok, coalesce(sm / nullif(sm + su, 0), 1.0) >= 0.7 AS skill_precision_ok,
              coalesce(jm / nullif(jm + jx, 0), 1.0) >= 0.75 AS job_recall_ok, coalesce(om / nullif(om + ox, 0), 1.0) >= 0.75 AS organization_recall_ok, coalesce(n, 0) BETWEEN 5 AND 15 AS skill_count_ok, c_custkey % 2 = 0 AS name_ok
       FROM customer LEFT JOIN (SELECT doc_id, count(*) FILTER (etype = 'skills' AND status = 'matched') AS sm, count(*) FILTER (etype = 'skills' AND status = 'missing') AS sx,
              count(*) FILTER (etype = 'skills' AND status = 'unexpected') AS su, count(*) FILTER (etype = 'jobs' AND status = 'matched') AS jm, count(*) FILTER (etype = 'organizations' AND status = 'matched') AS om, count(*) FILTER (etype = 'organizations' AND status = 'missing') AS ox, count(*) FILTER (etype = 'jobs' AND status = 'missing') AS jx
              FROM detail GROUP BY 1) d ON d.doc_id = c_custkey LEFT JOIN (SELECT doc_id AS i, count(*) AS n FROM got WHERE etype = 'skills' GROUP BY 1) g ON i = c_custkey""",
)
def _(c):
    got, want = _keys(c)
    n = got.filter("etype = 'skills'").groupBy("doc_id").agg(F.count("*").alias("n_skills"))
    cust = c.t("customer").select(F.col("c_custkey").alias("doc_id"), "c_name").join(n, "doc_id", "left")
    odd = F.col("doc_id") % 2 == 1
    counts = cust.select(
        "doc_id", F.coalesce("n_skills", F.lit(0)).alias("n_skills"), F.lit(5).alias("skills_min"), F.lit(15).alias("skills_max"),
        F.when(odd, F.lit("Somebody Else")).otherwise(F.upper("c_name")).alias("got_name"), F.col("c_name").alias("want_name"),
    )
    return K.threshold_check(got, want, counts)


@query(
    "lint_gold",
    """SELECT doc_id, 'absent_type_in_gold' AS rule, 'jobs' AS detail FROM (SELECT DISTINCT doc_id FROM want WHERE etype = 'jobs') WHERE doc_id % 3 = 0
       UNION ALL SELECT c_custkey, 'absent_and_present', 'jobs' FROM customer WHERE c_custkey % 6 = 0
       UNION ALL SELECT c_custkey, 'present_type_empty', e FROM (SELECT c_custkey, unnest(CASE WHEN c_custkey % 2 = 0 THEN ['jobs', 'certifications'] ELSE ['skills'] END) AS e FROM customer) x
           WHERE NOT EXISTS (SELECT 1 FROM want w WHERE w.doc_id = c_custkey AND w.etype = e)
       UNION ALL SELECT doc_id, 'excluded_in_gold', key FROM want WHERE etype = 'skills' AND key IN ('red ring', 'hot bolt')
       UNION ALL SELECT c_custkey, 'duplicate_id', '2' FROM customer WHERE c_mktsegment = 'BUILDING'
       UNION ALL SELECT * FROM (SELECT DISTINCT coalesce(a.doc_id, b.doc_id), 'normalized_differs', coalesce(a.etype, b.etype) || ':' || coalesce(a.key, b.key)
           FROM (SELECT * FROM want WHERE etype <> 'skills' AND doc_id IN (SELECT doc_id FROM got)) a FULL JOIN (SELECT * FROM got WHERE etype <> 'skills') b ON a.doc_id = b.doc_id AND a.etype = b.etype AND a.key = b.key
           WHERE a.key IS NULL OR b.key IS NULL)""",
)
def _(c):
    cust = c.t("customer").select(F.col("c_custkey").alias("doc_id"), "c_mktsegment")
    empty = F.array().cast("array<string>")
    excluded = F.array(*[F.struct(F.lit("skills").alias("etype"), F.lit(t).alias("text")) for t in ("Red  Ring", "HOT bolt")])
    manifest = cust.select(
        "doc_id", "c_mktsegment",
        F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("jobs"))).otherwise(empty).alias("absent_types"),
        F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("jobs"), F.lit("certifications"))).otherwise(F.array(F.lit("skills"))).alias("present_types"),
        excluded.alias("excluded"),
    )
    # One segment's entries are listed twice, with nothing in the second copy.
    blank = manifest.filter("c_mktsegment = 'BUILDING'").select(
        "doc_id", "c_mktsegment", empty.alias("absent_types"), empty.alias("present_types"), F.slice("excluded", 1, 0).alias("excluded")
    )
    got, want = _keys(c)
    return K.lint_gold(manifest.unionByName(blank).drop("c_mktsegment"), want, got)


_SECRETS = " UNION ALL ".join(f"SELECT doc_id, 'secret' AS kind, '{n}' AS what FROM documents WHERE regexp_matches(text, '{p}')" for n, p in SECRET_PATTERNS.items())


@query(
    "scan_secrets",
    f"""{_SECRETS} UNION ALL SELECT * FROM (SELECT DISTINCT doc_id, 'email_domain', rtrim(split_part(e, '@', -1), '.') AS d
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL_PATTERN}')) AS e FROM documents)) WHERE d NOT IN ('example.com', 'example.org')""",
)
def _(c):
    return K.scan_secrets(c.t("documents").select("doc_id", "text"))


@query(
    "scan_secrets_pages",
    f"""{_SECRETS.replace('doc_id', 'page_id').replace('documents', 'pages').replace('text', 'html')} UNION ALL SELECT * FROM (SELECT DISTINCT page_id, 'email_domain', rtrim(split_part(e, '@', -1), '.') AS d
        FROM (SELECT page_id, unnest(regexp_extract_all(html, '{EMAIL_PATTERN}')) AS e FROM pages)) WHERE d NOT IN ('example.com', 'example.org')""",
)
def _(c):
    return K.scan_secrets(c.t("pages").select("page_id", "html"), "html")


@query(
    "test_run_summary",
    """SELECT session_id, count(*) AS total, count(*) FILTER (status = 'complete') AS passed, count(*) FILTER (status = 'error') AS failed,
              count(*) FILTER (status IN ('pending', 'processing')) AS skipped, round(count(*) FILTER (status = 'complete') / count(*) * 100, 6) AS pass_rate
       FROM event GROUP BY 1""",
)
def _(c):
    status = F.when(F.col("event") == "complete", "PASS").when(F.col("event") == "error", "FAIL").otherwise("SKIP")
    return K.test_run_summary(c.events.withColumn("status", status), ("session_id",))


@query(
    "provider_comparison",
    """SELECT user_id || '' AS provider, round_even(max(value), 1) AS extraction_time_sec, count(*) AS total_entities, count(*) FILTER (event_type = 'click') AS jobs,
              count(*) FILTER (event_type = 'view') AS skills, round(0.75, 2)::DOUBLE AS avg_confidence, 80.0::DOUBLE AS accuracy_percent FROM events GROUP BY 1""",
)
def _(c):
    kind = F.when(F.col("event_type") == "click", "jobs").when(F.col("event_type") == "view", "skills").otherwise(F.col("event_type"))
    per = c.t("events").groupBy("user_id", kind.alias("k")).agg(F.count("*").alias("n"), F.max("value").alias("v"))
    metrics = per.groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("entities_extracted"), F.max("v").alias("extraction_time_sec")
    )
    return K.provider_comparison(
        metrics.select(
            F.col("user_id").cast("string").alias("provider"), "extraction_time_sec", "entities_extracted",
            F.lit(0.75).alias("avg_confidence"), F.lit(80.0).alias("accuracy_percent"),
        )
    )


@query(
    "acceptance",
    """SELECT s.session_id, coalesce(u, 0) AS unknown_nodes, persons, skills, coalesce(d, 0) AS distinct_skills, coalesce(u, 0) = 0 AS no_unknown_nodes, persons = 1 AS single_person, skills = coalesce(d, 0) AS skills_deduplicated
       FROM (SELECT session_id, count(*) FILTER (kind = 'person') AS persons, count(*) FILTER (kind = 'skill') AS skills, count(*) FILTER (kind = 'unknown') AS u FROM node GROUP BY 1) s
       LEFT JOIN (SELECT session_id, count(DISTINCT lower(trim(label))) AS d FROM raw_skill GROUP BY 1) USING (session_id)""",
)
def _(c):
    t = c.triples
    return K.acceptance(t, view.unknown_nodes(t), c.raw_skill)



@query("render_eval_report")
def _(c):
    return K.render_eval_report(_detail(c))


@query("render_batch_lines")
def _(c):
    return K.render_batch_lines(_detail(c))
