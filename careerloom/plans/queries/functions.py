"""Scalar functions over whole tables."""

from pyspark.sql import functions as F

from careerloom import functions as fn
from careerloom import vocab as V
from careerloom.plans.oracle import RES, _case, _local, title_ratio
from careerloom.plans.queries.registry import query

_AS_OF = "DATE '2001-01-01'"


@query(
    "url_decode_label",
    "SELECT session_id, job_id, raw_label AS label, url_decode(replace(raw_label, '+', '%2B')) AS decoded, count(*) AS n FROM line GROUP BY ALL",
)
def _(c):
    return c.line.groupBy("session_id", "job_id", F.col("raw_label").alias("label")).agg(F.count("*").alias("n")).withColumn(
        "decoded", fn.url_decode_label("label")
    )


@query("case_key", "SELECT p_partkey, lower(trim('  ' || p_name || ' ')) AS k FROM part")
def _(c):
    return c.t("part").select("p_partkey", fn.case_key(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("k"))


@query(
    "match_key",
    r"SELECT doc_id, md5(replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss')) AS k FROM documents",
)
def _(c):
    # Blanks in these texts are ASCII, so SQL's \s sees the same ones.
    return c.t("documents").select("doc_id", F.md5(fn.match_key("text")).alias("k"))


@query(
    "org_match_key",
    r"""SELECT session_id, doc_id, org_id, regexp_replace(trim(regexp_replace(lower(trim(name)), '[,.]?\s*(inc|llc|ltd|corp|co)\.?$', ''), ' ,.'), '^the ', '') AS k
        FROM raw_org""",
)
def _(c):
    return c.raw_org.select("session_id", "doc_id", "org_id", fn.org_match_key("name").alias("k"))


@query(
    "org_dedup_key",
    r"""SELECT s_suppkey, trim(regexp_replace(regexp_replace(lower(n), '^the ', ''), '(\s*,? (inc|llc|ltd|corp|co)\.?\s*)+$', '')) AS k
        FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'The ' || s_name || ' Corp, Inc.' WHEN 1 THEN s_name || ' Co. Ltd' ELSE s_name END AS n FROM supplier)""",
)
def _(c):
    k = F.col("s_suppkey") % 3
    name = (
        F.when(k == 0, F.concat(F.lit("The "), "s_name", F.lit(" Corp, Inc.")))
        .when(k == 1, F.concat("s_name", F.lit(" Co. Ltd")))
        .otherwise(F.col("s_name"))
    )
    return c.t("supplier").select("s_suppkey", fn.org_dedup_key(name).alias("k"))


@query("alnum_key", "SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS k FROM customer")
def _(c):
    return c.t("customer").select("c_custkey", fn.alnum_key("c_name").alias("k"))


@query("taxonomy_key", "SELECT p_partkey, replace(lower(p_name), ' ', '_') AS k FROM part")
def _(c):
    return c.t("part").select("p_partkey", fn.taxonomy_key("p_name").alias("k"))


@query("mint_iri", f"SELECT c_custkey, '{RES}' || url_encode(c_name || ' / é+~*') AS iri FROM customer")
def _(c):
    return c.t("customer").select("c_custkey", fn.mint_iri(F.concat("c_name", F.lit(" / é+~*"))).alias("iri"))


@query("iri_local_name", f"SELECT DISTINCT p, url_decode({_local('p')}) AS name, replace(url_decode(split_part(o, '/', -1)), '_', ' ') AS target FROM triple WHERE o_kind = 'iri' AND NOT contains(o, '#')")
def _(c):
    t = c.triples.filter("o_kind = 'iri' and not contains(o, '#')")
    return t.select("p", fn.iri_local_name("p").alias("name"), fn.iri_local_name("o", spaces=True).alias("target")).distinct()


_PARTIAL = """SELECT o_orderkey, o_orderkey % 5 AS style, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m')
              WHEN 2 THEN strftime(o_orderdate, '%Y') WHEN 3 THEN 'Present' ELSE strftime(o_orderdate, '%B %Y') END AS raw, o_orderdate AS d FROM orders"""


@query(
    "parse_partial_date",
    f"""SELECT o_orderkey, strftime(CASE style WHEN 0 THEN d WHEN 1 THEN date_trunc('month', d) WHEN 2 THEN date_trunc('year', d) END, '%Y-%m-%d') AS parsed FROM ({_PARTIAL})""",
)
def _(c):
    style, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    raw = (
        F.when(style == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(style == 1, F.date_format(d, "yyyy-MM"))
        .when(style == 2, F.date_format(d, "yyyy"))
        .when(style == 3, F.lit("Present"))
        .otherwise(F.date_format(d, "MMMM yyyy"))
    )
    return c.t("orders").select("o_orderkey", fn.parse_partial_date(raw).cast("string").alias("parsed"))


@query(
    "parse_any_date",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL WHEN o_orderkey % 6 = 4 AND day(o_orderdate) <= 12
              THEN strftime(make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)), '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS parsed,
              CASE WHEN o_orderkey % 6 = 5 THEN NULL WHEN o_orderkey % 6 IN (1, 2) THEN strftime(o_orderdate, '%Y-%m-%d') || ' 13:45:10'
                   WHEN o_orderkey % 6 = 4 AND day(o_orderdate) <= 12 THEN strftime(make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)), '%Y-%m-%d') || ' 00:00:00'
                   ELSE strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' END AS stamp
       FROM orders""",
)
def _(c):
    style, d = F.col("o_orderkey") % 6, F.col("o_orderdate")
    raw = (
        F.when(style == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(style == 1, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T13:45:10Z")))
        .when(style == 2, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" 13:45:10")))
        .when(style == 3, F.date_format(d, "MM/dd/yyyy"))
        .when(style == 4, F.date_format(d, "dd/MM/yyyy"))
        .otherwise(F.lit("some day"))
    )
    return c.t("orders").select(
        "o_orderkey", fn.parse_any_date(raw).cast("string").alias("parsed"),
        F.date_format(fn.parse_any_timestamp(raw), "yyyy-MM-dd HH:mm:ss").alias("stamp"),
    )


@query(
    "job_duration",
    f"""SELECT job_id, months, round_even(months / 12.0, 1) AS years FROM (
            SELECT job_id, CAST(greatest(0, (year(e) - year(start_date)) * 12 + month(e) - month(start_date)) AS BIGINT) AS months
            FROM (SELECT job_id, start_date, coalesce(end_date, {_AS_OF}) AS e FROM job))""".replace(
        "round_even(months / 12.0, 1)",
        # Half-even on one digit, written out: ties sit at .x5 of months / 12 and come from months % 6 = 3.
        "CAST(CASE WHEN months % 6 = 3 THEN 2 * round(months / 12.0 / 0.2) * 0.1 ELSE round(months / 12.0, 1) END AS DECIMAL(10, 1))::DOUBLE",
    ),
)
def _(c):
    return c.job.select(
        "job_id", fn.duration_months("start_date", "end_date", c.as_of).cast("long").alias("months"),
        fn.duration_years("start_date", "end_date", c.as_of).alias("years"),
    )


@query("is_expired", f"SELECT cert_id, expiration_date < {_AS_OF} AS expired FROM raw_cert")
def _(c):
    return c.raw_cert.select("cert_id", fn.is_expired("expiration_date", c.as_of).alias("expired"))


@query(
    "org_slug",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 4 IN (1, 2) THEN 'org-' || replace(lower(s_name), '#', '-') WHEN s_suppkey % 4 = 0 THEN 'org-acme-' || s_suppkey
              ELSE 'org-' || s_suppkey END AS slug FROM supplier""",
)
def _(c):
    k = F.col("s_suppkey") % 4
    n = F.col("s_suppkey").cast("string")
    cand = (
        F.when(k == 0, F.concat(F.lit(" Acme "), n, F.lit("! ")))
        .when(k == 1, F.lit("org-{{uuid}}"))
        .when(k == 2, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("org-"), n))
    )
    return c.t("supplier").select("s_suppkey", fn.org_slug(cand, "s_name").alias("slug"))


@query(
    "degree_label",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment || ' in Human Design' WHEN 1 THEN c_mktsegment WHEN 2 THEN 'Degree at ' || c_name ELSE 'Education' END AS label
       FROM customer""",
)
def _(c):
    k = F.col("c_custkey") % 4
    return c.t("customer").select(
        "c_custkey",
        fn.degree_label(F.when(k < 2, F.col("c_mktsegment")), F.when(k == 0, "Human Design"), F.when(k < 3, F.col("c_name"))).alias("label"),
    )


@query(
    "first_nonempty",
    "SELECT skill_id, session_id, coalesce(nullif(category, ''), nullif(proficiency_level, ''), label) AS v FROM raw_skill",
)
def _(c):
    return c.raw_skill.select("skill_id", "session_id", fn.first_nonempty("category", "proficiency_level", "label").alias("v"))


@query(
    "node_style",
    f"""SELECT kind, confidence, CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END AS band,
               {_case('kind', V.NODE_SHAPE, "'dot'")} AS shape, {_case('kind', V.NODE_COLOR, "'#95A5A6'")} AS color,
               CASE WHEN kind = 'person' THEN 18 WHEN kind IN ('job', 'organization') THEN 14 ELSE 12 END AS font_size,
               CAST(floor({_case('kind', V.NODE_BASE_SIZE, '10')} * (CAST(0.7 AS DOUBLE) + CAST(0.3 AS DOUBLE) * confidence)) AS INTEGER) AS size, count(*) AS n
        FROM node GROUP BY ALL""",
)
def _(c):
    from careerloom.operators import view

    return view.nodes(c.triples).groupBy("kind", "confidence", "band", "shape", "color", "font_size", "size").agg(F.count("*").alias("n"))


@query(
    "edge_style",
    f"""SELECT p, {_case('p', V.PREDICATE_LABEL, _local('p'))} AS label, {_case('p', V.EDGE_CLASS, "'other'")} AS edge_class, count(*) AS n FROM triple GROUP BY ALL""",
)
def _(c):
    t = c.triples.groupBy("p").agg(F.count("*").alias("n"))
    return t.select("p", fn.predicate_label("p").alias("label"), fn.edge_class("p").alias("edge_class"), "n")


_NAMES = "SELECT DISTINCT p_name AS t1, lower(p_type || ' ' || p_name) AS t2 FROM part"


def _names(c):
    return c.t("part").select(F.col("p_name").alias("t1"), F.lower(F.concat("p_type", F.lit(" "), "p_name")).alias("t2")).distinct()


@query(
    "title_similarity",
    """SELECT a.t AS t1, b.t AS t2, round(1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)), 6) AS similarity
       FROM (SELECT DISTINCT p_name AS t, split_part(p_name, ' ', 1) AS w FROM part) a JOIN (SELECT DISTINCT p_name AS t, split_part(p_name, ' ', 1) AS w FROM part) b USING (w)
       WHERE a.t < b.t""",
)
def _(c):
    """Every pair of different names with the same first word."""
    names = c.t("part").select(F.col("p_name").alias("t"), F.substring_index("p_name", " ", 1).alias("w")).distinct()
    pairs = names.withColumnRenamed("t", "t1").join(names.withColumnRenamed("t", "t2"), "w").filter("t1 < t2")
    return pairs.select("t1", "t2", F.round(fn.edit_similarity("t1", "t2"), 6).alias("similarity"))


@query("sequence_similarity", f"SELECT t1, t2, round({title_ratio('t1', 't2')}, 6) AS similarity FROM ({_NAMES})")
def _(c):
    return _names(c).select("t1", "t2", F.round(fn.title_similarity("t1", "t2"), 6).alias("similarity"))


@query(
    "dates_within_days",
    "SELECT to_job, abs(date_diff('day', a.start_date, b.start_date)) <= 30 AS close FROM step JOIN job a ON a.job_id = from_job JOIN job b ON b.job_id = to_job",
)
def _(c):
    from careerloom.operators import analyze

    day = lambda p: c.job.select(F.col("job_id").alias(f"{p}_job"), F.col("start_date").alias(f"{p}_date"))
    s = analyze.consecutive_jobs(c.job).join(day("from"), "from_job").join(day("to"), "to_job")
    return s.select("to_job", fn.dates_within_days("from_date", "to_date", 30).alias("close"))


@query("content_hash", "SELECT doc_id, md5(text) AS hash FROM documents")
def _(c):
    return c.t("documents").select("doc_id", fn.content_hash("text").alias("hash"))


@query(
    "recover_json",
    """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k, event_id % 4 = 3 AS failed FROM events""",
)
def _(c):
    style = F.col("event_id") % 4
    reply = (
        F.when(style == 0, F.col("props"))
        .when(style == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .when(style == 2, F.concat(F.lit("Here it is: "), "props", F.lit(" Hope that helps.")))
        .otherwise(F.regexp_replace("props", r"\}$", ""))
    )
    r = fn.recover_json(reply, "k bigint")
    return c.t("events").select("event_id", F.col("event_id").isNotNull().alias("_"), r.alias("r")).select(
        "event_id", F.col("r.k").alias("k"), F.col("r").isNull().alias("failed")
    )


@query(
    "bracket_citations",
    """SELECT conv_id, turn, role, len(regexp_extract_all(text || ' [' || role || ' + skill_gap] and [done]', '\\[([^\\[\\]]*)\\]')) AS n,
              array_to_string(regexp_extract_all(text || ' [' || role || ' + skill_gap] and [done]', '\\[([^\\[\\]]*)\\]'), ';') AS spans FROM conversations""".replace("\\\\", "\\"),
)
def _(c):
    text = F.concat("text", F.lit(" ["), "role", F.lit(" + skill_gap] and [done]"))
    spans = fn.bracket_citations(text)
    return c.t("conversations").select("conv_id", "turn", "role", F.size(spans).cast("long").alias("n"), F.array_join(spans, ";").alias("spans"))
