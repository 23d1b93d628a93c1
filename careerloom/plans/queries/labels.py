"""Label reconciliation."""

from pyspark.sql import functions as F

from careerloom import vocab as V
from careerloom.functions import mint_iri, url_decode_label
from careerloom.operators import normalize as N
from careerloom.plans.queries.registry import query


@query("label_pools", "SELECT session_id, pool, label, declared, verified, uri FROM label")
def _(c):
    return c.labels


@query("phase1_case", "SELECT session_id, pool, label, c1 AS canonical FROM label_case WHERE label <> c1")
def _(c):
    return N.phase1_case(c.labels)


@query(
    "phase1_case_declared",
    """SELECT * FROM (SELECT session_id, pool, label, first_value(label) OVER (PARTITION BY session_id, pool, lower(trim(label))
              ORDER BY NOT declared, NOT (upper(label[1]) = label[1] AND lower(label[1]) <> label[1]), -length(label), label) AS canonical FROM label)
       WHERE label <> canonical""",
)
def _(c):
    return N.phase1_case(c.labels, prefer_declared=True)


@query("phase2_uri", "SELECT DISTINCT session_id, 'skill' AS pool, c1 AS label, c2 AS canonical FROM label_uri WHERE c1 <> c2")
def _(c):
    return N.phase2_uri(c.labels, N.phase1_case(c.labels))


@query("phase3_alias", "SELECT session_id, 'skill' AS pool, label, canonical FROM alias")
def _(c):
    return N.phase3_alias(c.alias_groups)


@query("chain_maps", "SELECT session_id, pool, label, canonical, phase FROM label_map")
def _(c):
    return c.label_map.drop("verified")


@query("anchor_verified", "SELECT session_id, pool, label, canonical FROM label_map WHERE phase = 'verified'")
def _(c):
    return c.label_map.filter("phase = 'verified'").select("session_id", "pool", "label", "canonical")


_NEW = "CASE WHEN user_verified THEN r.label ELSE coalesce(m.canonical, d) END"


@query(
    "apply_to_skills",
    f"""SELECT r.session_id, skill_id, {_NEW} AS label,
               array_to_string(CASE WHEN user_verified OR coalesce(m.canonical, d) = d OR list_contains(alt_labels, d) THEN alt_labels ELSE list_append(alt_labels, d) END, '|') AS alts
        FROM (SELECT *, url_decode(replace(label, '+', '%2B')) AS d FROM raw_skill) r
        LEFT JOIN label_map m ON m.session_id = r.session_id AND m.pool = 'skill' AND m.label = d""",
)
def _(c):
    c.store("line", "raw_skill")
    return N.apply_to_skills(c.raw_skill, c.label_map).select("session_id", "skill_id", "label", F.array_join("alt_labels", "|").alias("alts"))


@query(
    "apply_to_job_tech",
    """SELECT t.session_id, job_id, coalesce(m.canonical, d) AS label, min(pos) AS pos
       FROM (SELECT *, url_decode(replace(label, '+', '%2B')) AS d FROM raw_tech) t
       LEFT JOIN label_map m ON m.session_id = t.session_id AND m.pool = 'skill' AND m.label = d GROUP BY 1, 2, 3""",
)
def _(c):
    return N.apply_to_job_tech(c.raw_tech, c.label_map)


@query(
    "apply_to_orgs",
    """SELECT o.session_id, doc_id, org_id, coalesce(m.canonical, o.name) AS name
       FROM raw_org o LEFT JOIN label_map m ON m.session_id = o.session_id AND m.pool = 'org' AND m.label = o.name""",
)
def _(c):
    return N.apply_to_orgs(c.raw_org, c.label_map).select("session_id", "doc_id", "org_id", "name")


@query(
    "apply_to_education",
    """SELECT e.session_id, edu_id, coalesce(m.canonical, e.degree_type) AS degree_type
       FROM raw_edu e LEFT JOIN label_map m ON m.session_id = e.session_id AND m.pool = 'degree' AND m.label = e.degree_type""",
)
def _(c):
    return N.apply_to_education(c.raw_edu, c.label_map).select("session_id", "edu_id", "degree_type")


@query(
    "normalization_report",
    """SELECT *, CAST(round_even((1 - final_unique_labels / original_labels) * 100, 1) AS DOUBLE) AS reduction_pct FROM (
           SELECT session_id, count(*) AS original_labels, count(DISTINCT pool || chr(1) || canonical) AS final_unique_labels,
                  count(*) FILTER (label <> canonical) AS total_merges, count(*) FILTER (label <> canonical AND phase = 'case') AS case_merges,
                  count(*) FILTER (label <> canonical AND phase = 'uri') AS uri_merges, count(*) FILTER (label <> canonical AND phase = 'alias') AS alias_merges
           FROM label_map GROUP BY 1)""",
)
def _(c):
    return N.normalization_report(c.label_map)


@query(
    "phase_gate",
    """SELECT g.session_id, canonical, len(members) AS n_members FROM alias_group g
       WHERE session_id IN (SELECT session_id FROM (SELECT session_id, doc_id, bool_and(status <> 'P') AS ok FROM job GROUP BY 1, 2) WHERE ok GROUP BY 1 HAVING count(*) >= 2)""",
)
def _(c):
    docs = c.job.groupBy("session_id", "doc_id").agg(F.min(F.col("status") != "P").alias("ok")).withColumn(
        "status", F.when(F.col("ok"), "complete").otherwise("processing")
    )
    return N.phase_gate(c.alias_groups, docs).select("session_id", "canonical", F.size("members").cast("long").alias("n_members"))


@query(
    "tech_index",
    """SELECT *, count(*) OVER (PARTITION BY session_id, label) AS n_jobs FROM (SELECT DISTINCT session_id, url_decode(replace(label, '+', '%2B')) AS label, job_id FROM raw_tech)""",
)
def _(c):
    return N.tech_index(c.raw_tech)


_SKILL_LABEL = f"""SELECT t.*, m.canonical FROM triple t LEFT JOIN moved m ON m.session_id = t.session_id AND m.label = t.o
    WHERE p = '{V.PREF_LABEL}' AND (t.session_id, s) IN (SELECT session_id, s FROM triple WHERE p = '{V.RDF_TYPE}' AND o = '{V.TYPE_IRI['skill']}')"""


@query(
    "rewrite_triples",
    f"""SELECT DISTINCT * FROM (
        WITH triples AS (SELECT session_id, s, p, o, o_kind, o_type FROM triple WHERE p <> '{V.USED_TECH}' UNION ALL SELECT DISTINCT session_id, '{V.RES}' || url_encode(job_id), '{V.USED_TECH}',
                '{V.RES}' || url_encode(url_decode(replace(label, '+', '%2B'))), 'iri', NULL FROM raw_tech),
            moved AS (SELECT session_id, label, canonical FROM label_map WHERE pool = 'skill' AND label <> canonical), named AS ({_SKILL_LABEL})
        SELECT session_id, s, p, o, o_kind, o_type FROM triples WHERE p NOT IN ('{V.PREF_LABEL}', '{V.USED_TECH}')
        UNION ALL SELECT session_id, s, p, o, o_kind, o_type FROM triples t WHERE p = '{V.PREF_LABEL}' AND NOT EXISTS (SELECT 1 FROM named n WHERE n.session_id = t.session_id AND n.s = t.s)
        UNION ALL SELECT session_id, s, p, coalesce(canonical, o), o_kind, o_type FROM named
        UNION ALL SELECT n.session_id, n.s, '{V.ALT_LABEL}', v.label, o_kind, o_type FROM named n JOIN moved v ON v.session_id = n.session_id AND v.canonical = n.canonical
        UNION ALL SELECT t.session_id, s, p, CASE WHEN m.canonical IS NULL THEN o ELSE '{V.RES}' || url_encode(m.canonical) END, o_kind, o_type
        FROM triples t LEFT JOIN moved m ON m.session_id = t.session_id AND m.label = url_decode(split_part(o, '/', -1)) WHERE p = '{V.USED_TECH}')""",
)
def _(c):
    """The used technologies are named by their labels, as written, in their IRIs."""
    used = c.raw_tech.select(
        "session_id", mint_iri("job_id").alias("s"), F.lit(V.USED_TECH).alias("p"), mint_iri(url_decode_label("label")).alias("o"),
        F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_type"),
    )
    triples = c.triples.filter(F.col("p") != V.USED_TECH).unionByName(used.distinct())
    return N.rewrite_triples(triples, c.label_map)
