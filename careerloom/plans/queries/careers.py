"""Structural analyses and taxonomy matching."""

from pyspark.sql import functions as F

from careerloom.operators import analyze as A
from careerloom.operators import taxonomy as J
from careerloom.plans.queries.registry import query


@query("resolve_tech", "SELECT session_id, job_id, tech_key, label FROM tech")
def _(c):
    return c.tech


@query("skill_gap", "SELECT session_id, key, label, status, n_roles, category, proficiency_level FROM gap")
def _(c):
    return A.skill_gap(c.skill, c.tech)


@query(
    "skill_gap_summary",
    """SELECT session_id, count(*) FILTER (status <> 'used_only') AS claimed_count, count(*) FILTER (status <> 'claimed_only') AS used_count,
              count(*) FILTER (status = 'both') AS overlap_count FROM gap GROUP BY 1""",
)
def _(c):
    return A.skill_gap_summary(A.skill_gap(c.skill, c.tech))


@query("claimed_not_used", "SELECT session_id, key, label, category, proficiency_level FROM gap WHERE status = 'claimed_only'")
def _(c):
    return A.claimed_not_used(c.skill, c.tech)


@query(
    "used_not_claimed",
    """SELECT t.session_id, tech_key, t.label, t.job_id, title, st AS start, en AS "end" FROM tech t JOIN ordered_job j ON j.job_id = t.job_id
       WHERE NOT EXISTS (SELECT 1 FROM skill s WHERE s.session_id = t.session_id AND lower(s.label) = tech_key)""",
)
def _(c):
    return A.used_not_claimed(c.skill, c.tech, c.job)


@query("technology_spread", "SELECT session_id, tech_key, label, n_jobs, role FROM spread")
def _(c):
    return A.technology_spread(c.tech)


@query(
    "role_connections",
    """SELECT DISTINCT a.session_id, a.job_id, j.title, k.title AS other_title FROM tech a JOIN tech b ON b.session_id = a.session_id AND b.tech_key = a.tech_key AND b.job_id <> a.job_id
       JOIN job j ON j.job_id = a.job_id JOIN job k ON k.job_id = b.job_id""",
)
def _(c):
    return A.role_connections(c.tech, c.job)


@query("isolated_roles", "SELECT session_id, job_id, title FROM isolated")
def _(c):
    return A.isolated_roles(c.tech, c.job)


@query(
    "tech_timeline",
    """SELECT j.session_id, j.job_id, row_number() OVER (PARTITION BY j.session_id ORDER BY ord) AS pos, title, st || ' – ' || en AS period, is_current, coalesce(tools, '') AS tools
       FROM ordered_job j LEFT JOIN (SELECT session_id, job_id, string_agg(label, ', ' ORDER BY label) AS tools FROM tech GROUP BY 1, 2) t USING (session_id, job_id)""",
)
def _(c):
    return A.tech_timeline(c.job, c.tech).select("session_id", "job_id", F.col("pos").cast("long"), "title", "period", "is_current", "tools")


@query("tech_transitions", "SELECT session_id, from_job, to_job, tech_key, change FROM transition")
def _(c):
    return A.tech_transitions(c.job, c.tech).select("session_id", "from_job", "to_job", "tech_key", "change")


@query("explicit_hierarchy", "SELECT session_id, skill_id, label, direction, name FROM link")
def _(c):
    return A.explicit_hierarchy(c.skill)


@query("orphans", "SELECT session_id, skill_id, label FROM skill WHERE len(broader_concepts) = 0 AND len(narrower_concepts) = 0")
def _(c):
    return A.orphans(c.skill)


@query("by_category", "SELECT session_id, coalesce(category, 'Uncategorized') AS category, count(*) AS n_skills FROM skill GROUP BY 1, 2")
def _(c):
    return A.by_category(c.skill)


@query("by_taxonomy_group", "SELECT session_id, broader_label AS group_label, count(*) AS n_skills FROM grouped GROUP BY 1, 2")
def _(c):
    return A.by_taxonomy_group(A.with_taxonomy_group(c.skill, c.matches))


@query(
    "taxonomy_share",
    """SELECT session_id, count(*) AS total, count(broader_label) AS matched, count(*) - count(broader_label) AS unmatched, count(broader_label) * 100 // count(*) AS pct
       FROM grouped GROUP BY 1""",
)
def _(c):
    return A.taxonomy_share(A.with_taxonomy_group(c.skill, c.matches))


@query(
    "taxonomy_coverage",
    "SELECT session_id, count(*) AS total, count(skos_uri) AS linked, CAST(round_even(count(skos_uri) / count(*) * 100, 0) AS BIGINT) AS coverage_pct FROM skill GROUP BY 1",
)
def _(c):
    return A.taxonomy_coverage(c.skill)


@query(
    "role_progression",
    "SELECT session_id, count(*) AS total_roles, count(DISTINCT title) AS unique_titles, arg_min(st, ord) AS first_start FROM ordered_job GROUP BY 1",
)
def _(c):
    return A.role_progression(c.job)


@query("repeated_titles", "SELECT session_id, title, count(*) AS n_roles FROM job GROUP BY 1, 2 HAVING count(*) > 1")
def _(c):
    return A.repeated_titles(c.job)


@query("repeated_orgs", "SELECT session_id, org_id, count(*) AS n_roles FROM job WHERE org_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def _(c):
    return A.repeated_orgs(c.job)


# ---------------------------------------------------------------- taxonomy

@query("taxonomy_match_score", "SELECT label, concept_uri, CAST(score AS INTEGER) AS score FROM candidate")
def _(c):
    return J.match_candidates(c.taxonomy_labels, c.taxonomy, limit=None).select("label", "concept_uri", "score")


@query(
    "match_candidates",
    "SELECT label, concept_uri, CAST(score AS INTEGER) AS score, CAST(rk AS INTEGER) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, pref_label, concept_uri) AS rk FROM candidate) WHERE rk <= 5",
)
def _(c):
    return J.match_candidates(c.taxonomy_labels, c.taxonomy).select("label", "concept_uri", "score", "rk")


@query("best_match", "SELECT label, concept_uri, preferred_label, CAST(score AS INTEGER) AS score FROM best")
def _(c):
    return J.best_match(J.match_candidates(c.taxonomy_labels, c.taxonomy, limit=None))


@query("broader_of", "SELECT label, concept_uri, broader_uri, broader_label FROM broader")
def _(c):
    return J.broader_of(J.best_match(J.match_candidates(c.taxonomy_labels, c.taxonomy, limit=None)), c.taxonomy).select(
        "label", "concept_uri", "broader_uri", "broader_label"
    )


@query("drop_circular", "SELECT label, concept_uri, preferred_label, broader_uri, broader_label FROM uncircular")
def _(c):
    hits = J.broader_of(J.best_match(J.match_candidates(c.taxonomy_labels, c.taxonomy, limit=None)), c.taxonomy)
    return J.drop_circular(hits).select("label", "concept_uri", "preferred_label", "broader_uri", "broader_label")


def _incremental(c):
    """Half of the labels have stored results, some of them misses."""
    first = c.taxonomy_labels.filter("label not like '% %'")
    return J.lookup_incremental(c.taxonomy_labels, J.lookup(first, c.taxonomy), c.taxonomy)


@query(
    "lookup_incremental",
    "SELECT lower(trim(l.label)) AS label_key, concept_uri, preferred_label, broader_uri, broader_label FROM tax_label l LEFT JOIN uncircular u ON u.label = l.label",
)
def _(c):
    return _incremental(c)


@query(
    "match_stats",
    """SELECT count(*) AS total, count(concept_uri) AS matched, count(*) - count(concept_uri) AS unmatched, count(DISTINCT broader_label) AS concept_labels
       FROM tax_label LEFT JOIN uncircular USING (label)""",
)
def _(c):
    return J.match_stats(_incremental(c))


_CATS = """(VALUES ('technical', NULL, 'programming,data_science,cloud_infrastructure,databases'), ('programming', 'technical', 'python,javascript,java,sql,r'),
    ('data_science', 'technical', 'machine_learning,data_analysis,statistical_analysis,data_visualization'),
    ('cloud_infrastructure', 'technical', 'aws,azure,docker,kubernetes'), ('soft_skills', NULL, 'leadership,communication,problem_solving,teamwork')) AS k(cat, up, down)"""


@query(
    "link_taxonomy",
    f"""SELECT session_id, skill_id, coalesce(skos_uri, uri) AS skos_uri,
               CASE WHEN bare THEN coalesce(up, '') ELSE array_to_string(broader_concepts, ',') END AS broader,
               CASE WHEN bare THEN coalesce(down, '') ELSE array_to_string(narrower_concepts, ',') END AS narrower
        FROM (SELECT *, len(broader_concepts) = 0 AND len(narrower_concepts) = 0 AS bare,
                     CASE WHEN split_part(label, ' ', 1) = 'new' THEN 'Data Science' WHEN split_part(label, ' ', 1) = 'small' THEN 'Technical' ELSE label END AS l FROM skill)
        LEFT JOIN (SELECT DISTINCT replace(p_name, ' ', '_') AS u, 'urn:old:' || md5(p_name) AS uri FROM part) ON u = replace(lower(l), ' ', '_')
        LEFT JOIN {_CATS} ON cat = replace(lower(l), ' ', '_')""",
)
def _(c):
    first = F.substring_index("label", " ", 1)
    label = F.when(first == "new", "Data Science").when(first == "small", "Technical").otherwise(F.col("label"))
    uris = c.t("part").select(
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("taxonomy_key"), F.concat(F.lit("urn:old:"), F.md5("p_name")).alias("uri")
    ).distinct()
    out = J.link_taxonomy(c.skill.withColumn("label", label), uris, J.category_table(c.spark))
    return out.select(
        "session_id", "skill_id", "skos_uri", F.array_join("broader_concepts", ",").alias("broader"), F.array_join("narrower_concepts", ",").alias("narrower")
    )
