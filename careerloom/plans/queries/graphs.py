"""Graph construction, view and validation."""

from pyspark.sql import functions as F

from careerloom import vocab as V
from careerloom.operators import graph as G
from careerloom.operators import validate as H
from careerloom.operators import view
from careerloom.operators.common import keep
from careerloom.plans.oracle import _IS_EDGE, RES, _local
from careerloom.plans.queries.registry import query
from careerloom.runtime import cut

_PLAIN = "session_id, s, p, o, o_kind, o_type"
_JOB, _SKILL, _PERSON = V.TYPE_IRI["job"], V.TYPE_IRI["skill"], V.TYPE_IRI["person"]


#: Records that most graph queries read, by session.
_RECORDS = ("line", "job", "raw_skill", "raw_edu", "raw_org", "raw_cert")


def _of(prefix: str, kinds: str) -> str:
    return f"SELECT {_PLAIN} FROM triple WHERE (session_id, s) IN (SELECT session_id, s FROM triple WHERE p = '{V.RDF_TYPE}' AND o = '{V.TYPE_IRI[kinds]}')"


# ---------------------------------------------------------------- identity

@query("dedup_skills", "SELECT session_id, id, canonical_id FROM skill_map")
def _(c):
    return G.dedup_skills(c.raw_skill)


@query("dedup_orgs", "SELECT session_id, id, canonical_id FROM org_map")
def _(c):
    return G.dedup_orgs(c.raw_org)


@query("dedup_jobs_exact", "SELECT session_id, id, canonical_id FROM job_exact")
def _(c):
    return G.dedup_jobs_exact(c.job, c.org_map)


@query("dedup_jobs_fuzzy", "SELECT session_id, id, canonical_id FROM job_map")
def _(c):
    return G.dedup_jobs(c.job, c.org_map)


@query("dedup_education", "SELECT session_id, id, canonical_id FROM edu_map")
def _(c):
    return G.dedup_education(c.raw_edu, c.org_map)


@query("dedup_certifications", "SELECT session_id, id, canonical_id FROM cert_map")
def _(c):
    return G.dedup_certifications(c.raw_cert)


@query(
    "canonical_refs",
    "SELECT j.session_id, job_id, coalesce(m.canonical_id, j.org_id) AS org_id FROM job j LEFT JOIN org_map m ON m.session_id = j.session_id AND m.id = j.org_id",
)
def _(c):
    return G.canonical_refs(c.job.select("session_id", "job_id", "org_id"), "org_id", c.org_map)


# ---------------------------------------------------------------- triples

@query("build_graph", f"SELECT {_PLAIN} FROM triple")
def _(c):
    return c.build_triples()


@query("provenance_triples", f"SELECT {_PLAIN} FROM triple WHERE p IN ('{V.CONFIDENCE}', '{V.SOURCE_DOC}', '{V.CREATED_AT}')")
def _(c):
    c.store(*_RECORDS)
    orgs = keep(c.org_map, c.buckets)
    kept = [
        (c.job, "job_id", G.dedup_jobs(c.job, orgs, buckets=c.buckets)), (c.raw_skill, "skill_id", c.skill_map), (c.raw_org, "org_id", orgs),
        (c.raw_edu, "edu_id", G.dedup_education(c.raw_edu, orgs)), (c.raw_cert, "cert_id", G.dedup_certifications(c.raw_cert)),
    ]
    out = G.provenance_triples(c.merged_person, "person_id")
    for df, col, ids in kept:
        out = out.unionByName(G.provenance_triples(G.survivors(df, col, keep(ids, c.buckets)), col))
    return out


@query(
    "entity_triples_skill",
    f"SELECT {_PLAIN} FROM triple WHERE p <> '{V.ALT_LABEL}' AND (session_id, s) IN (SELECT session_id, s FROM triple WHERE p = '{V.RDF_TYPE}' AND o = '{_SKILL}')",
)
def _(c):
    return G.skill_triples(G.survivors(c.raw_skill, "skill_id", c.skill_map))


@query("entity_triples_certification", _of("c", "certification"))
def _(c):
    return G.certification_triples(G.survivors(c.raw_cert, "cert_id", G.dedup_certifications(c.raw_cert)), c.as_of)


@query("entity_triples_organization", _of("o", "organization"))
def _(c):
    return G.organization_triples(G.survivors(c.raw_org, "org_id", c.org_map))


@query("entity_triples_education", _of("e", "education"))
def _(c):
    orgs = cut(c.org_map)
    edu = G.survivors(c.raw_edu, "edu_id", G.dedup_education(c.raw_edu, orgs))
    return G.education_triples(G.canonical_refs(edu, "institution_id", orgs))


@query(
    "entity_triples_job",
    f"SELECT {_PLAIN} FROM triple WHERE p NOT IN ('{V.USED_SKILL}', '{V.USED_TECH}') AND (session_id, s) IN (SELECT session_id, s FROM triple WHERE p = '{V.RDF_TYPE}' AND o = '{_JOB}')",
)
def _(c):
    orgs = cut(c.org_map)
    jobs = G.survivors(c.job, "job_id", G.dedup_jobs(c.job, orgs))
    return G.job_triples(G.canonical_refs(jobs, "org_id", orgs))


@query(
    "entity_triples_person",
    f"""SELECT {_PLAIN} FROM triple WHERE (session_id, s) IN (SELECT session_id, s FROM triple WHERE p = '{V.RDF_TYPE}' AND o = '{_PERSON}')
        AND p NOT IN ('{V.HAS_JOB}', '{V.HAS_SKILL}', '{V.HAS_CERT}', '{V.ALUMNI_OF}')""",
)
def _(c):
    return G.person_triples(c.merged_person)


def _id_maps(c):
    c.store(*_RECORDS, "raw_person", "raw_refs")
    orgs = keep(c.org_map, c.buckets)
    kinds = {
        "job": G.dedup_jobs(c.job, orgs, buckets=c.buckets), "skill": c.skill_map,
        "education": G.dedup_education(c.raw_edu, orgs), "certification": G.dedup_certifications(c.raw_cert),
    }
    out = None
    for k, m in kinds.items():
        part = keep(m, c.buckets).select("session_id", F.lit(k).alias("kind"), "id", "canonical_id")
        out = part if out is None else out.unionByName(part)
    return keep(out, c.buckets, placed=True)


@query("person_edges", f"SELECT {_PLAIN} FROM triple WHERE p IN ('{V.HAS_JOB}', '{V.HAS_SKILL}', '{V.HAS_CERT}', '{V.ALUMNI_OF}')")
def _(c):
    maps = _id_maps(c)
    return G.person_edges(c.merged_refs, maps)


@query(
    "unresolved_person_refs",
    "SELECT r.session_id, r.kind, count(*) AS skipped FROM merged_refs r ANTI JOIN id_maps m ON m.session_id = r.session_id AND m.kind = r.kind AND m.id = r.id GROUP BY 1, 2",
)
def _(c):
    maps = _id_maps(c)
    return G.unresolved_person_refs(c.merged_refs, maps)


@query("accumulate_alt_labels", f"SELECT {_PLAIN} FROM triple WHERE p = '{V.ALT_LABEL}'")
def _(c):
    return G.alt_labels(c.raw_skill, c.skill_map)


_COUNTS = ", ".join(f"count(*) FILTER (p = '{V.RDF_TYPE}' AND o = '{iri}') AS {k}_count" for k, iri in V.TYPE_IRI.items())


@query("graph_stats", f"SELECT session_id, count(*) AS triple_count, {_COUNTS} FROM triple GROUP BY 1")
def _(c):
    return G.graph_stats(c.triples)


@query(
    "match_pattern",
    f"""SELECT a.session_id, a.s AS person, b.s AS job, c.o AS org, d.o AS org_name FROM triple a JOIN triple b ON b.session_id = a.session_id AND b.s = a.o
        JOIN triple c ON c.session_id = b.session_id AND c.s = b.s JOIN triple d ON d.session_id = c.session_id AND d.s = c.o
        WHERE a.p = '{V.HAS_JOB}' AND b.p = '{V.TITLE}' AND b.o = '1-URGENT' AND c.p = '{V.HIRING_ORG}' AND d.p = '{V.NAME}'""",
)
def _(c):
    rows = G.match_pattern(
        c.triples,
        [("?person", V.HAS_JOB, "?job"), ("?job", V.TITLE, "1-URGENT"), ("?job", V.HIRING_ORG, "?org"), ("?org", V.NAME, "?org_name")],
    )
    return rows.select("session_id", "person", "job", "org", "org_name")


@query(
    "skills_in_jobs_titled",
    f"""SELECT DISTINCT u.session_id, u.o AS skill, l.o AS label FROM triple t JOIN triple u ON u.session_id = t.session_id AND u.s = t.s
        JOIN triple l ON l.session_id = u.session_id AND l.s = u.o
        WHERE t.p = '{V.TITLE}' AND contains(lower(t.o), 'urgent') AND u.p = '{V.USED_SKILL}' AND l.p = '{V.PREF_LABEL}'""",
)
def _(c):
    return G.skills_in_jobs_titled(c.triples, "Urgent")


@query(
    "unowned_used_skills",
    f"""SELECT DISTINCT session_id, o AS skill FROM triple u WHERE p = '{V.USED_SKILL}'
        AND NOT EXISTS (SELECT 1 FROM triple h WHERE h.p = '{V.HAS_SKILL}' AND h.session_id = u.session_id AND h.o = u.o)""",
)
def _(c):
    return G.unowned_used_skills(c.triples)


# ---------------------------------------------------------------- view

@query("nodes", "SELECT session_id, id, label, kind, confidence FROM node")
def _(c):
    return view.node_labels(c.triples)


@query("edges", "SELECT session_id, source, target, p, label, edge_class FROM edge")
def _(c):
    return view.edges(c.triples).drop("color", "width")


@query(
    "edge_stats",
    """SELECT session_id, edge_class, label, CAST(grouping(edge_class) * 2 + grouping(label) AS INTEGER) AS grouping, count(*) AS n
       FROM edge GROUP BY GROUPING SETS ((session_id, edge_class), (session_id, label), (session_id, edge_class, label))""",
)
def _(c):
    return view.edge_stats(view.edges(c.triples))


@query("node_type_counts", "SELECT session_id, kind, count(*) AS n FROM node GROUP BY 1, 2")
def _(c):
    return view.node_type_counts(view.node_labels(c.triples))


@query(
    "full_edge_list",
    f"""SELECT t.session_id, t.s, t.p, t.o, CASE t.p {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in V.PREDICATE_LABEL.items())} ELSE {_local('t.p')} END AS label,
               a.label AS source_label, a.kind AS source_kind, coalesce(b.label, url_decode({_local('t.o')})) AS target_label, coalesce(b.kind, 'unknown') AS target_kind
        FROM triple t LEFT JOIN node a ON a.session_id = t.session_id AND a.id = t.s LEFT JOIN node b ON b.session_id = t.session_id AND b.id = t.o
        WHERE o_kind = 'iri'""",
)
def _(c):
    return view.full_edge_list(c.triples)


def _centers(c):
    """Every organization of every career is a centre."""
    return c.raw_org.select("session_id", F.concat(F.lit(RES), "org_id").alias("center")).distinct()


@query(
    "ego_graph",
    f"""SELECT * FROM (
        WITH ctr AS (SELECT DISTINCT session_id, '{RES}' || org_id AS center FROM raw_org),
        ie AS (SELECT session_id, s, p, o FROM triple WHERE o_kind = 'iri'),
        adj AS (SELECT DISTINCT session_id, s AS a, o AS b FROM ie UNION SELECT DISTINCT session_id, o, s FROM ie),
        h0 AS (SELECT session_id, center, center AS id, 0 AS hops FROM ctr WHERE (session_id, center) IN (SELECT session_id, a FROM adj)),
        h1 AS (SELECT DISTINCT h.session_id, center, b AS id, 1 AS hops FROM h0 h JOIN adj ON adj.session_id = h.session_id AND a = id),
        h2 AS (SELECT DISTINCT h.session_id, center, b AS id, 2 AS hops FROM h1 h JOIN adj ON adj.session_id = h.session_id AND a = id),
        near AS (SELECT session_id, center, id, CAST(min(hops) AS INTEGER) AS hops FROM (FROM h0 UNION ALL FROM h1 UNION ALL FROM h2) GROUP BY 1, 2, 3)
        SELECT n.session_id, n.center, n.id, n.hops, x.p, x.o FROM near n
        LEFT JOIN (SELECT ie.session_id, y.center, ie.s, ie.p, ie.o FROM ie JOIN near y ON y.session_id = ie.session_id AND y.id = ie.o) x
        ON x.session_id = n.session_id AND x.center = n.center AND x.s = n.id)""",
)
def _(c):
    """Every node of a neighbourhood with its statements about others of it; without one, a row with no statement."""
    near, inside = view.ego_graph(c.triples, _centers(c), depth=2, buckets=c.buckets)
    return near.join(inside.withColumnRenamed("s", "id"), ["session_id", "center", "id"], "left").select(
        "session_id", "center", "id", "hops", "p", "o"
    )


@query(
    "ego_graph_edges",
    f"""SELECT * FROM (
        WITH ctr AS (SELECT DISTINCT session_id, '{RES}' || org_id AS center FROM raw_org),
        ie AS (SELECT session_id, s, p, o FROM triple WHERE o_kind = 'iri'),
        near AS (SELECT session_id, center, center AS id FROM ctr UNION SELECT c.session_id, center, s FROM ctr c JOIN ie ON ie.session_id = c.session_id AND o = center
                 UNION SELECT c.session_id, center, o FROM ctr c JOIN ie ON ie.session_id = c.session_id AND s = center)
        SELECT ie.session_id, x.center, ie.s, ie.p, ie.o FROM ie JOIN near x ON x.session_id = ie.session_id AND x.id = ie.s
        JOIN near y ON y.session_id = ie.session_id AND y.id = ie.o AND y.center = x.center
        WHERE (ie.session_id, x.center) IN (SELECT session_id, s FROM ie UNION SELECT session_id, o FROM ie))""",
)
def _(c):
    return view.ego_graph(c.triples, _centers(c), depth=1, buckets=c.buckets)[1]


@query(
    "node_tooltip",
    f"""SELECT n.session_id, n.id, concat_ws('<br>', '<b>' || n.label || '</b>', '<i>Type: ' || n.kind || '</i>',
              CASE WHEN n.kind = 'person' THEN 'Email: ' || n.email END, CASE WHEN n.kind = 'person' THEN 'Location: ' || n.address END,
              CASE WHEN n.kind = 'job' THEN 'Title: ' || n.title END, CASE WHEN n.kind = 'job' THEN 'Organization: ' || o.label END,
              CASE WHEN n.kind = 'skill' THEN 'Category: ' || n.category END, CASE WHEN n.kind = 'skill' THEN 'Proficiency: ' || n.proficiency END,
              CASE WHEN n.kind = 'education' THEN 'Degree: ' || n.degree END, CASE WHEN n.kind = 'education' THEN 'Field: ' || n.field END,
              CASE WHEN n.confidence < 1 THEN 'Confidence: ' || CAST(round(n.confidence * 100) AS INTEGER) || '%' END) AS tooltip
       FROM node n LEFT JOIN (SELECT session_id, id, label FROM node WHERE (session_id, id) IN (SELECT session_id, o FROM triple WHERE p = '{V.HIRING_ORG}')) o
       ON o.session_id = n.session_id AND o.id = n.org""",
)
def _(c):
    return view.node_tooltip(c.triples)


@query(
    "unknown_nodes",
    f"""SELECT u.session_id, u.id, u.label, d.degree, CASE WHEN d.linked > 3 THEN d.top || '...' ELSE d.top END AS connected
        FROM node u JOIN (SELECT session_id, id, CAST(sum(n) AS BIGINT) AS degree, count(*) AS linked,
                                 array_to_string(list(label ORDER BY label, other)[1:3], ', ') AS top
                          FROM (SELECT b.session_id, b.id, b.other, m.label, count(*) AS n
                                FROM (SELECT session_id, s AS id, o AS other FROM triple WHERE {_IS_EDGE}
                                      UNION ALL SELECT session_id, o, s FROM triple WHERE {_IS_EDGE} AND s <> o) b
                                JOIN node m ON m.session_id = b.session_id AND m.id = b.other GROUP BY 1, 2, 3, 4) GROUP BY 1, 2) d
        ON d.session_id = u.session_id AND d.id = u.id WHERE u.kind = 'unknown'""",
)
def _(c):
    return view.unknown_nodes(c.triples)


@query(
    "type_summary",
    f"""SELECT session_id, kind, label, CAST(list_position([{', '.join(repr(t) for t in V.TYPE_ORDER)}], kind) AS INTEGER) AS type_order, count(*) AS n_nodes,
               CAST(sum(count(*)) OVER (PARTITION BY session_id, kind) AS BIGINT) AS type_total
        FROM node WHERE kind <> 'unknown' GROUP BY 1, 2, 3""",
)
def _(c):
    return view.type_summary(view.node_labels(c.triples))


@query(
    "visible_subgraph",
    """SELECT e.session_id, source, target, p FROM edge e WHERE (session_id, source) IN (SELECT session_id, id FROM node WHERE kind NOT IN ('skill', 'unknown'))
       AND (session_id, target) IN (SELECT session_id, id FROM node WHERE kind NOT IN ('skill', 'unknown'))""",
)
def _(c):
    t = c.triples
    return view.visible_subgraph(view.node_labels(t), view.edges(t), ["skill", "unknown"])[1].select("session_id", "source", "target", "p")


# ---------------------------------------------------------------- validation

def _dangling(preds, level, check):
    names = ", ".join(f"'{p}'" for p in preds)
    return f"""SELECT session_id, '{level}' AS level, '{check}' AS "check", s AS subject, {_local('p')} || ' points at ' || o || ', which has no typed node in the graph' AS message
        FROM triple t WHERE p IN ({names}) AND o_kind = 'iri' AND starts_with(o, '{RES}')
        AND NOT EXISTS (SELECT 1 FROM typed y WHERE y.session_id = t.session_id AND y.s = t.o)"""


_H1 = _dangling(V.CORE_RELATIONS, "error", "dangling_reference")
_H2 = _dangling(V.HIERARCHY_RELATIONS, "warning", "skos_dangling")
_HT = _dangling((V.USED_TECH,), "warning", "technology_dangling")


def _job_rule(check, tail, preds):
    names = ", ".join(f"'{p}'" for p in preds)
    return f"""SELECT j.session_id, 'warning' AS level, '{check}' AS "check", j.s AS subject, 'Job ''' || l.o || '{tail}' AS message
        FROM triple j JOIN triple l ON l.session_id = j.session_id AND l.s = j.s AND l.p = '{V.PREF_LABEL}'
        WHERE j.p = '{V.RDF_TYPE}' AND j.o = '{_JOB}' AND NOT EXISTS (SELECT 1 FROM triple x WHERE x.session_id = j.session_id AND x.s = j.s AND x.p IN ({names}))"""


_H3 = f"""SELECT session_id, 'error' AS level, 'missing_label' AS "check", s AS subject, 'Entity ' || s || ' has no non-empty skos:prefLabel' AS message
    FROM triple t WHERE p = '{V.RDF_TYPE}' AND NOT EXISTS (SELECT 1 FROM triple x WHERE x.session_id = t.session_id AND x.s = t.s AND x.p = '{V.PREF_LABEL}' AND trim(x.o) <> '')"""
_NODE_RULES = " UNION ALL ".join(
    [
        _H3,
        _job_rule("job_missing_organization", "'' has no schema:hiringOrganization link", (V.HIRING_ORG,)),
        _job_rule("job_missing_dates", "'' has no schema:startDate", (V.START,)),
        _job_rule("job_no_technologies", "'' lists no usedTechnology or usedSkill", (V.USED_TECH, V.USED_SKILL)),
    ]
)
_H7 = f"""SELECT session_id, 'warning' AS level, 'near_duplicate_skills' AS "check", k AS subject,
        'Skill labels [''' || string_agg(label, ''', ''' ORDER BY label) || '''] look like variants of the same skill' AS message
    FROM (SELECT DISTINCT session_id, regexp_replace(lower(label), '[^a-z0-9]+', '', 'g') AS k, label FROM node WHERE kind = 'skill')
    GROUP BY session_id, k HAVING count(*) > 1"""
_H8 = f"""SELECT session_id, 'warning' AS level, 'no_person' AS "check", '' AS subject, 'Graph contains no Person node' AS message
    FROM triple GROUP BY 1 HAVING NOT bool_or(p = '{V.RDF_TYPE}' AND o = '{_PERSON}')"""
# What extraction produced: whole documents' records, before deduplication.
_EXTRACTED = """SELECT session_id, 'skill' AS kind, count(*) AS extracted FROM raw_skill GROUP BY 1
    UNION ALL SELECT session_id, 'job', count(*) FROM job GROUP BY 1 UNION ALL SELECT session_id, 'organization', count(*) FROM raw_org GROUP BY 1
    UNION ALL SELECT session_id, 'education', count(*) FROM raw_edu GROUP BY 1 UNION ALL SELECT session_id, 'person', count(*) FROM raw_person GROUP BY 1
    UNION ALL SELECT session_id, 'certification', count(*) FROM job GROUP BY 1"""
_H9 = f"""SELECT e.session_id, CASE WHEN coalesce(g.n, 0) = 0 THEN 'error' ELSE 'warning' END AS level,
        CASE WHEN coalesce(g.n, 0) = 0 THEN 'type_missing_in_export' ELSE 'low_entity_count' END AS "check", e.kind AS subject,
        CASE WHEN coalesce(g.n, 0) = 0 THEN 'Extraction produced ' || extracted || ' ' || e.kind || ' entities but the graph contains none'
             ELSE 'Graph has ' || g.n || ' ' || e.kind || ' entities but extraction produced ' || extracted || ' (more than half lost — check deduplication)' END AS message
    FROM ({_EXTRACTED}) e LEFT JOIN (SELECT session_id, kind, count(*) AS n FROM node GROUP BY 1, 2) g ON g.session_id = e.session_id AND g.kind = e.kind
    WHERE coalesce(g.n, 0) < extracted * 0.5 AND extracted > 0"""


def _extracted(c):
    part = lambda df, kind: df.groupBy("session_id").agg(F.count("*").alias("extracted")).withColumn("kind", F.lit(kind))
    out = part(c.raw_skill, "skill")
    for df, kind in ((c.job, "job"), (c.raw_org, "organization"), (c.raw_edu, "education"), (c.raw_person, "person"), (c.job, "certification")):
        out = out.unionByName(part(df, kind))
    return out.select("session_id", "kind", "extracted")


@query("dangling_references", _H1)
def _(c):
    return H.dangling_references(c.triples)


@query("hierarchy_dangling", _H2)
def _(c):
    return H.hierarchy_dangling(c.triples)


@query("technology_dangling", _HT)
def _(c):
    return H.technology_dangling(c.triples)


@query("node_rules", _NODE_RULES)
def _(c):
    return H.node_rules(c.triples)


def _damaged(c):
    """The graph without labels, dates and persons, so that every rule has work."""
    t = c.triples
    person = (F.col("p") == V.RDF_TYPE) & (F.col("o") == _PERSON)
    return t.filter(~F.col("p").isin(V.PREF_LABEL, V.START) & ~person)


_BROKEN = f"SELECT * FROM triple WHERE p NOT IN ('{V.PREF_LABEL}', '{V.START}') AND NOT (p = '{V.RDF_TYPE}' AND o = '{_PERSON}')"


@query(
    "node_rules_damaged",
    f"""SELECT session_id, 'error' AS level, 'missing_label' AS "check", s AS subject, 'Entity ' || s || ' has no non-empty skos:prefLabel' AS message FROM ({_BROKEN}) WHERE p = '{V.RDF_TYPE}'
        UNION ALL SELECT session_id, 'warning', 'job_missing_dates', s, 'Job ''' || s || ''' has no schema:startDate' FROM ({_BROKEN}) WHERE p = '{V.RDF_TYPE}' AND o = '{_JOB}'
        UNION ALL SELECT session_id, level, "check", subject, 'Job ''' || subject || CASE "check" WHEN 'job_missing_organization' THEN ''' has no schema:hiringOrganization link' ELSE ''' lists no usedTechnology or usedSkill' END
        FROM ({_NODE_RULES}) WHERE "check" IN ('job_missing_organization', 'job_no_technologies')""",
)
def _(c):
    return H.node_rules(_damaged(c))


@query("near_duplicate_skills", _H7)
def _(c):
    return H.near_duplicate_skills(c.triples)


@query(
    "near_duplicate_skills_damaged",
    f"""SELECT session_id, 'warning' AS level, 'near_duplicate_skills' AS "check", k AS subject,
        'Skill labels [''' || string_agg(label, ''', ''' ORDER BY label) || '''] look like variants of the same skill' AS message
    FROM (SELECT DISTINCT session_id, regexp_replace(lower(label), '[^a-z0-9]+', '', 'g') AS k, label
          FROM (SELECT session_id, s, min(replace(o, '%20', '-')) AS label FROM triple WHERE p = '{V.PREF_LABEL}' GROUP BY 1, 2)
          WHERE (session_id, s) IN (SELECT session_id, s FROM triple WHERE p = '{V.RDF_TYPE}' AND o = '{_SKILL}'))
    GROUP BY session_id, k HAVING count(*) > 1""",
)
def _(c):
    """Labels whose blanks came as %20 are spelled with hyphens."""
    label = F.when(F.col("p") == V.PREF_LABEL, F.replace("o", F.lit("%20"), F.lit("-"))).otherwise(F.col("o"))
    return H.near_duplicate_skills(c.triples.withColumn("o", label))


@query("no_person", f"SELECT DISTINCT session_id, 'warning' AS level, 'no_person' AS \"check\", '' AS subject, 'Graph contains no Person node' AS message FROM ({_BROKEN})")
def _(c):
    return H.no_person(_damaged(c))


@query("completeness", _H9)
def _(c):
    return H.completeness(c.triples, _extracted(c))


@query(
    "validation_report",
    f"""SELECT s.*, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(errors, 0) = 0 AS valid
        FROM (SELECT session_id, count(*) AS triple_count, {_COUNTS} FROM triple GROUP BY 1) s
        LEFT JOIN (SELECT session_id, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings
                   FROM ({_H1} UNION ALL {_H2} UNION ALL {_HT} UNION ALL {_NODE_RULES} UNION ALL {_H7} UNION ALL {_H8} UNION ALL {_H9}) GROUP BY 1) i USING (session_id)""",
)
def _(c):
    return H.validation_report(c.triples, _extracted(c))


def _shape_sql(source: str) -> str:
    """Every rule on its own, unlike the one-pass operator."""
    parts = []
    for s in H.SHAPES:
        focus = f"SELECT session_id, s FROM {source} WHERE p = '{V.RDF_TYPE}' AND o = '{V.TYPE_IRI[s.kind]}'"
        checks = []
        if s.min_count:
            checks.append(("min_count", f"count(v.o) AS n", f"count(v.o) < {s.min_count}"))
        if s.max_count is not None:
            checks.append(("max_count", f"count(v.o) AS n", f"count(v.o) > {s.max_count}"))
        if s.datatypes:
            ok = ", ".join(f"'{d}'" for d in s.datatypes)
            bad = f"count(v.o) FILTER (NOT (v.o_kind = 'literal' AND coalesce(v.o_type IN ({ok}), false)))"
            checks.append(("datatype", f"{bad} AS n", f"{bad} > 0"))
        if s.iri:
            bad = "count(v.o) FILTER (v.o_kind <> 'iri')"
            checks.append(("node_kind", f"{bad} AS n", f"{bad} > 0"))
        for name, n, broken in checks:
            parts.append(
                f"SELECT session_id, s AS subject, '{s.rule}' AS rule, '{name}' AS \"constraint\", '{s.severity}' AS severity, n AS n_values FROM ("
                f"SELECT f.session_id, f.s, {n} FROM ({focus}) f LEFT JOIN {source} v ON v.session_id = f.session_id AND v.s = f.s AND v.p = '{s.path}' "
                f"GROUP BY 1, 2 HAVING {broken})"
            )
    return " UNION ALL ".join(parts)


_BENT = f"""(SELECT session_id, s, p, o, CASE WHEN p = '{V.USED_TECH}' THEN 'literal' ELSE o_kind END AS o_kind,
             CASE WHEN p = '{V.START}' THEN '{V.XSD_STRING}' WHEN p = '{V.CONFIDENCE}' THEN '{V.XSD_STRING}' ELSE o_type END AS o_type
             FROM triple WHERE p NOT IN ('{V.HAS_SKILL}', '{V.NAME}'))"""


@query("check_shapes", _shape_sql("triple"))
def _(c):
    return H.check_shapes(c.triples).drop("message")


@query("check_shapes_damaged", f"SELECT * FROM (WITH bent AS MATERIALIZED {_BENT} {_shape_sql('bent')})")
def _(c):
    t = c.triples.filter(~F.col("p").isin(V.HAS_SKILL, V.NAME))
    bent = t.withColumns(
        {
            "o_kind": F.when(F.col("p") == V.USED_TECH, "literal").otherwise(F.col("o_kind")),
            "o_type": F.when(F.col("p").isin(V.START, V.CONFIDENCE), V.XSD_STRING).otherwise(F.col("o_type")),
        }
    )
    return H.check_shapes(bent).drop("message")


def _unlabelled(preds, rule, message, source="triple"):
    names = ", ".join(f"'{p}'" for p in preds)
    return f"""SELECT DISTINCT session_id, o AS subject, '{rule}' AS rule, 'warning' AS severity, '{message}' AS message FROM {source} t
        WHERE p IN ({names}) AND NOT EXISTS (SELECT 1 FROM {source} x WHERE x.session_id = t.session_id AND x.s = t.o AND x.p IN ('{V.NAME}', '{V.PREF_LABEL}', '{V.RDFS_LABEL}'))"""


@query(
    "unlabelled_organizations",
    _unlabelled((V.HIRING_ORG, V.ALUMNI_OF), "organization_label", "Recommended: Org/Institution nodes should have a human-readable label."),
)
def _(c):
    return H.unlabelled_organizations(c.triples)


@query(
    "unlabelled_certifications",
    _unlabelled((V.HAS_CERT,), "certification_label", "Recommended: Certification nodes should have a human-readable label."),
)
def _(c):
    return H.unlabelled_certifications(c.triples)


_NAMELESS = f"(SELECT * FROM triple WHERE NOT (p IN ('{V.NAME}', '{V.PREF_LABEL}', '{V.RDFS_LABEL}') AND s LIKE '%3'))"


def _nameless(c):
    """Nodes whose id ends with a 3 have lost their names."""
    return c.triples.filter(~(F.col("p").isin(V.NAME, V.PREF_LABEL, V.RDFS_LABEL) & F.col("s").endswith("3")))


@query(
    "unlabelled_organizations_damaged",
    _unlabelled((V.HIRING_ORG, V.ALUMNI_OF), "organization_label", "Recommended: Org/Institution nodes should have a human-readable label.", _NAMELESS),
)
def _(c):
    return H.unlabelled_organizations(_nameless(c))


@query(
    "unlabelled_certifications_damaged",
    _unlabelled((V.HAS_CERT,), "certification_label", "Recommended: Certification nodes should have a human-readable label.", _NAMELESS),
)
def _(c):
    return H.unlabelled_certifications(_nameless(c))
