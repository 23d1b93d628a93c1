"""Reference SQL over the test tables: named building blocks and their composition.

``compose`` prefixes a query with just the blocks it uses.
"""

from __future__ import annotations

import re

from careerloom import vocab as V

RES, ONT = V.RES, V.ONT
SK, SC = V.SKOS, V.SCHEMA


def _uri(name: str) -> str:
    first, last = f"split_part({name}, ' ', 1)", f"split_part({name}, ' ', -1)"
    return (
        f"CASE WHEN {first} <> 'old' THEN 'urn:skill:' || md5(CASE WHEN {first} IN ('hot', 'cold') "
        f"THEN 'temperature ' || {last} ELSE {name} END) END"
    )


def _mint(c: str) -> str:
    return f"'{RES}' || url_encode({c})"


def _cells(source: str, sid: str, *cells: tuple[str, str, str, str | None]) -> str:
    """Triples of one entity table: (predicate, value, kind, type)."""
    packed = ", ".join(
        f"{{'p': '{p}', 'o': CAST({o} AS VARCHAR), 'k': '{k}', 't': {'NULL' if t is None else repr(t)}}}" for p, o, k, t in cells
    )
    return (
        f"SELECT session_id, s, u.p AS p, u.o AS o, u.k AS o_kind, CAST(u.t AS VARCHAR) AS o_type FROM ("
        f"SELECT session_id, {_mint(sid)} AS s, unnest([{packed}]) AS u FROM {source}) WHERE coalesce(u.o, '') <> ''"
    )


def _many(source: str, sid: str, p: str, values: str, iri: bool) -> str:
    o = _mint("v") if iri else "v"
    kind, typ = ("iri", "NULL") if iri else ("literal", f"'{V.XSD_STRING}'")
    return (
        f"SELECT session_id, s, '{p}' AS p, {o} AS o, '{kind}' AS o_kind, CAST({typ} AS VARCHAR) AS o_type FROM ("
        f"SELECT session_id, {_mint(sid)} AS s, unnest({values}) AS v FROM {source})"
    )


def _lit(p: str, o: str, t: str = V.XSD_STRING):
    return (p, o, "literal", t)


def _iri(p: str, o: str):
    return (p, o, "iri", None)


def _base(kind: str, label: str):
    return (
        _iri(V.RDF_TYPE, f"'{V.TYPE_IRI[kind]}'"),
        _lit(V.PREF_LABEL, label),
        _lit(V.CONFIDENCE, "confidence", V.XSD_DOUBLE),
        _lit(V.SOURCE_DOC, "source_doc"),
        _lit(V.CREATED_AT, "strftime(created_at, '%Y-%m-%dT%H:%M:%S')", V.XSD_DATETIME),
    )


_ORG_KEY = (
    r"trim(regexp_replace(regexp_replace(lower(trim(name)), '^the ', ''), '(\s*,? (inc|llc|ltd|corp|co)\.?\s*)+$', ''))"
)
_YEAR_START = "make_timestamp(CAST({y} AS BIGINT), 1, 1, 0, 0, 0)"


def _local(c: str) -> str:
    return f"CASE WHEN contains({c}, '#') THEN split_part({c}, '#', -1) ELSE split_part({c}, '/', -1) END"


def _case(col: str, table: dict, default: str) -> str:
    body = " ".join(f"WHEN '{k}' THEN {v if isinstance(v, int) else repr(v)}" for k, v in table.items())
    return f"CASE {col} {body} ELSE {default} END"


_TYPE_NAME = "CASE o " + " ".join(f"WHEN '{v}' THEN '{k}'" for k, v in V.TYPE_IRI.items()) + " END"
_IS_EDGE = f"(o_kind = 'iri' AND p NOT IN ('{V.EXACT_MATCH}', '{V.RDF_TYPE}'))"



def common(a: str, b: str) -> str:
    """Length of the longest common subsequence of two short texts: positions of ``a`` are bits, one addition per character of ``b``."""
    full = f"((CAST(1 AS BIGINT) << length({a})) - 1)"
    match = (
        f"list_transform(range(1, length({b}) + 1), lambda j: coalesce(CAST(list_sum(list_transform(range(1, length({a}) + 1), "
        f"lambda i: CASE WHEN substr({a}, i, 1) = substr({b}, j, 1) THEN CAST(1 AS BIGINT) << (i - 1) ELSE 0 END)) AS BIGINT), 0))"
    )
    return f"bit_count({full} - list_reduce(list_prepend({full}, {match}), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full}))"


def title_ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = {b} THEN 1.0 ELSE 2.0 * {common(a, b)} / (length({a}) + length({b})) END)"


BLOCKS: dict[str, str] = {
    # ------------------------------------------------------------ raw records
    "doc": "SELECT DISTINCT o_custkey AS session_id, 'd' || o_custkey || '-' || year(o_orderdate) AS doc_id, year(o_orderdate) AS year FROM orders",
    "line": """
        SELECT o_custkey AS session_id, 'd' || o_custkey || '-' || year(o_orderdate) AS doc_id, year(o_orderdate) AS year,
               'j' || o_orderkey AS job_id, p_name, p_type, p_brand, p_size,
               CASE l_linenumber % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name ELSE replace(p_name, ' ', '%20') END AS raw_label,
               l_linenumber % 3 AS variant, l_returnflag AS flag, l_linenumber
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""",
    "job": """
        SELECT o_custkey AS session_id, 'd' || o_custkey || '-' || year(o_orderdate) AS doc_id, 'j' || o_orderkey AS job_id,
               o_orderpriority || CASE o_orderkey % 4 WHEN 1 THEN 's' WHEN 2 THEN ' I' ELSE '' END AS title, 's' || supp AS org_id, CAST(o_orderdate AS DATE) AS start_date,
               CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) + CAST(30 * (1 + coalesce(n, 0)) AS INTEGER) END AS end_date,
               o_orderstatus = 'O' AS is_current,
               CASE o_orderstatus WHEN 'F' THEN ['Closed order ' || o_orderkey, 'Reached ' || o_orderpriority, 'Kept the schedule']
                    WHEN 'P' THEN ['Opened order ' || o_orderkey] ELSE CAST([] AS VARCHAR[]) END AS achievements,
               CAST(CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'P' THEN 0.8 ELSE 0.6 END AS DOUBLE) AS confidence,
               'd' || o_custkey || '-' || year(o_orderdate) || '.txt' AS source_doc,
               make_timestamp(year(o_orderdate), 1, 1, 0, 0, 0) AS created_at, o_orderkey AS pos, o_orderstatus AS status
        FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS supp, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
    "raw_skill": f"""
        SELECT session_id, doc_id, doc_id || ':' || variant || ':' || replace(p_name, ' ', '-') AS skill_id, raw_label AS label, declared,
               CASE WHEN declared THEN nullif(t, 'PROMO') ELSE 'Technical' END AS category,
               CASE WHEN declared THEN b END AS proficiency_level,
               CASE WHEN declared THEN CAST(z AS DOUBLE) / 10.0 END AS years_experience,
               {_uri('p_name')} AS skos_uri,
               CASE WHEN z >= 25 THEN [split_part(p_name, ' ', -1)] ELSE CAST([] AS VARCHAR[]) END AS broader_concepts,
               CASE WHEN z % 7 = 0 THEN ['fine_' || split_part(p_name, ' ', -1), 'coarse_' || split_part(p_name, ' ', -1)] ELSE CAST([] AS VARCHAR[]) END AS narrower_concepts,
               CASE WHEN variant = 2 THEN [p_name || ' (alt)'] ELSE CAST([] AS VARCHAR[]) END AS alt_labels,
               (z >= 48 AND variant = 1) AS user_verified,
               CAST(CASE variant WHEN 0 THEN 0.95 WHEN 1 THEN 1.0 ELSE 0.65 END AS DOUBLE) AS confidence,
               doc_id || '.txt' AS source_doc, {_YEAR_START.format(y='year')} AS created_at, variant AS pos
        FROM (SELECT session_id, doc_id, year, p_name, variant, raw_label, bool_or(flag = 'R') AS declared,
                     min(p_type) AS t, min(p_brand) AS b, max(p_size) AS z
              FROM line WHERE flag = 'R' OR variant <> 2 GROUP BY ALL)""",
    "raw_tech": "SELECT session_id, job_id, l_linenumber AS pos, raw_label AS label FROM line WHERE flag <> 'R'",
    "job_skill": """
        SELECT session_id, job_id, doc_id || ':' || variant || ':' || replace(p_name, ' ', '-') AS skill_id,
               CASE WHEN flag = 'A' THEN 'skill' ELSE 'technology' END AS kind
        FROM line WHERE flag <> 'R'""",
    "doc_person": """
        SELECT doc.session_id, doc_id, year, c_name, c_mktsegment, n_nationkey, n_name, r_name
        FROM doc JOIN customer ON session_id = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "raw_edu": f"""
        SELECT session_id, doc_id, 'e' || doc_id AS edu_id, c_mktsegment || ' in ' || r_name AS label,
               CASE WHEN year % 2 = 0 THEN c_mktsegment ELSE upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) END AS degree_type,
               r_name AS field_of_study, 'u' || n_nationkey AS institution_id, CAST(1.0 AS DOUBLE) AS confidence,
               doc_id || '.txt' AS source_doc, {_YEAR_START.format(y='year')} AS created_at
        FROM doc_person""",
    "raw_org": f"""
        SELECT session_id, doc_id, org_id, name, org_type, pos, CAST(0.9 AS DOUBLE) AS confidence, doc_id || '.txt' AS source_doc,
               {_YEAR_START.format(y="split_part(doc_id, '-', -1)")} AS created_at
        FROM (SELECT DISTINCT session_id, doc_id, org_id FROM job WHERE org_id IS NOT NULL
              UNION ALL SELECT session_id, doc_id, institution_id FROM raw_edu)
        JOIN (SELECT 's' || s_suppkey AS org_id, 'Company' AS org_type, s_suppkey AS pos,
                     CASE (s_suppkey // 20) % 4 WHEN 0 THEN 'Supplier ' || s_suppkey % 20 || ', Inc.' WHEN 1 THEN 'Supplier ' || s_suppkey % 20 || ' LLC'
                          WHEN 2 THEN 'The Supplier ' || s_suppkey % 20 || ' Corp.' ELSE 'supplier ' || s_suppkey % 20 END AS name
              FROM supplier
              UNION ALL SELECT 'u' || n_nationkey, 'University', 1000000000, 'University of ' || n_name FROM nation WHERE n_nationkey % 5 <> 0)
        USING (org_id)""",
    "raw_cert": """
        SELECT session_id, doc_id, 'c' || job_id[2:] AS cert_id, 'Certified ' || title AS name, c_mktsegment AS issuing_organization,
               start_date AS issue_date, start_date + 730 AS expiration_date, CAST(0.85 AS DOUBLE) AS confidence, source_doc, created_at, pos
        FROM job JOIN customer ON c_custkey = session_id WHERE status = 'F'""",
    "raw_person": f"""
        SELECT session_id, doc_id, 'p' || doc_id AS person_id, c_name AS name, lower(replace(c_name, '#', '.')) || '@example.com' AS email,
               n_name AS location, CAST(1.0 AS DOUBLE) AS confidence, doc_id || '.txt' AS source_doc, {_YEAR_START.format(y='year')} AS created_at
        FROM doc_person""",
    "raw_refs": """
        SELECT session_id, 'p' || doc_id AS person_id, 'job' AS kind, job_id AS id FROM job
        UNION ALL SELECT session_id, 'p' || doc_id, 'skill', skill_id FROM raw_skill WHERE declared
        UNION ALL SELECT session_id, 'p' || doc_id, 'education', edu_id FROM raw_edu
        UNION ALL SELECT session_id, 'p' || doc_id, 'certification', cert_id FROM raw_cert
        UNION ALL SELECT session_id, 'p' || doc_id, 'certification', 'c' || job_id[2:] FROM job WHERE status = 'P'""",
    # ------------------------------------------------------------ organizations of extraction records
    "mention": """
        SELECT session_id, doc_id, 0 AS src, row_number() OVER (PARTITION BY doc_id ORDER BY pos, org_id) - 1 AS nr, name, org_id AS candidate, org_type
        FROM raw_org WHERE pos % 2 = 0
        UNION ALL SELECT session_id, doc_id, 1, nr, coalesce(company, oid), oid, 'Company' FROM (
            SELECT j.session_id, j.doc_id, row_number() OVER (PARTITION BY j.doc_id ORDER BY j.pos) - 1 AS nr, CASE WHEN j.pos % 3 <> 1 THEN o.name END AS company,
                   CASE WHEN j.pos % 3 <> 0 THEN j.org_id END AS oid
            FROM job j LEFT JOIN raw_org o ON o.doc_id = j.doc_id AND o.org_id = j.org_id) WHERE coalesce(company, oid) IS NOT NULL
        UNION ALL SELECT session_id, doc_id, 2, 0, institution_id, institution_id, 'University' FROM raw_edu""",
    "mention_root": """
        SELECT * FROM (
        WITH m AS (SELECT *, lower(trim(name)) AS key, src * 1000000 + nr AS ord FROM mention),
        owner AS (SELECT doc_id, candidate, arg_min(key, ord) AS dst FROM m WHERE candidate IS NOT NULL GROUP BY 1, 2),
        head AS (SELECT doc_id, key, min(ord) AS head, first(candidate ORDER BY ord) AS candidate FROM m GROUP BY 1, 2),
        hop AS (SELECT h.doc_id, h.key, o.dst FROM head h JOIN owner o ON o.doc_id = h.doc_id AND o.candidate = h.candidate WHERE o.dst <> h.key)
        SELECT m.*, h.head, coalesce(z.dst, y.dst, x.dst, m.key) AS root
        FROM m JOIN head h ON h.doc_id = m.doc_id AND h.key = m.key LEFT JOIN hop x ON x.doc_id = m.doc_id AND x.key = m.key
        LEFT JOIN hop y ON y.doc_id = m.doc_id AND y.key = x.dst LEFT JOIN hop z ON z.doc_id = m.doc_id AND z.key = y.dst)""",
    "registered": """
        SELECT *, CASE WHEN nth = 1 THEN slug ELSE slug || '-' || nth END AS org_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY ord) AS nth FROM (
                SELECT session_id, doc_id, root, min(ord) AS ord, first(name ORDER BY ord) AS name, first(org_type ORDER BY ord) AS org_type,
                       'org-' || coalesce(lower(first(candidate ORDER BY ord)), trim(regexp_replace(lower(trim(first(name ORDER BY ord))), '[^a-z0-9]+', '-', 'g'), '-')) AS slug
                FROM mention_root WHERE ord = head GROUP BY 1, 2, 3))""",
    "mention_org": "SELECT m.doc_id, src, nr, o.org_id FROM mention_root m JOIN registered o ON o.doc_id = m.doc_id AND o.root = m.root",
    # ------------------------------------------------------------ graph
    "lead_person": "SELECT * FROM raw_person QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY doc_id, person_id) = 1",
    "merged_refs": "SELECT DISTINCT r.session_id, l.person_id, kind, id FROM raw_refs r JOIN lead_person l ON l.session_id = r.session_id",
    "org_map": f"""
        SELECT DISTINCT session_id, org_id AS id,
               first_value(org_id) OVER (PARTITION BY session_id, {_ORG_KEY} ORDER BY doc_id, pos, org_id) AS canonical_id
        FROM raw_org""",
    "skill_map": """
        SELECT DISTINCT session_id, skill_id AS id,
               first_value(skill_id) OVER (PARTITION BY session_id, lower(trim(label)) ORDER BY doc_id, pos, skill_id) AS canonical_id
        FROM raw_skill""",
    "job_keyed": """
        SELECT j.session_id, job_id, lower(title) AS title, coalesce(m.canonical_id, j.org_id, '') AS org_key, start_date
        FROM job j LEFT JOIN org_map m ON m.session_id = j.session_id AND m.id = j.org_id""",
    "job_exact": "SELECT session_id, job_id AS id, min(job_id) OVER (PARTITION BY session_id, title, org_key, start_date) AS canonical_id FROM job_keyed",
    "job_alive": """
        SELECT k.*, row_number() OVER (PARTITION BY k.session_id, org_key ORDER BY start_date, job_id) AS rn
        FROM job_keyed k JOIN job_exact e ON e.session_id = k.session_id AND e.id = k.job_id AND e.id = e.canonical_id""",
    "job_greedy": f"""
        SELECT session_id, org_key, rn, job_id, job_id AS leader, [struct_pack(j := job_id, t := title, d := start_date)] AS leaders
        FROM job_alive WHERE rn = 1
        UNION ALL
        SELECT session_id, org_key, rn, job_id, coalesce(hit, job_id),
               CASE WHEN hit IS NULL THEN list_append(leaders, struct_pack(j := job_id, t := title, d := start_date)) ELSE leaders END
        FROM (SELECT n.session_id, n.org_key, n.rn, n.job_id, n.title, n.start_date, r.leaders,
                     list_filter(r.leaders, lambda x: abs(date_diff('day', x.d, n.start_date)) <= 30
                         AND {title_ratio('x.t', 'n.title')} >= 0.85)[1].j AS hit
              FROM job_greedy r JOIN job_alive n ON n.session_id = r.session_id AND n.org_key = r.org_key AND n.rn = r.rn + 1)""",
    "job_map": """
        SELECT e.session_id, e.id, coalesce(g.leader, e.canonical_id) AS canonical_id
        FROM job_exact e LEFT JOIN job_greedy g ON g.session_id = e.session_id AND g.job_id = e.canonical_id""",
    "edu_map": """
        SELECT e.session_id, edu_id AS id, first_value(edu_id) OVER (PARTITION BY e.session_id, lower(degree_type), lower(field_of_study),
               coalesce(m.canonical_id, institution_id) ORDER BY doc_id, edu_id) AS canonical_id
        FROM raw_edu e LEFT JOIN org_map m ON m.session_id = e.session_id AND m.id = institution_id""",
    "cert_map": """
        SELECT session_id, cert_id AS id, first_value(cert_id) OVER (PARTITION BY session_id, lower(name), lower(issuing_organization)
               ORDER BY doc_id, pos, cert_id) AS canonical_id
        FROM raw_cert""",
    "id_maps": """
        SELECT session_id, 'job' AS kind, id, canonical_id FROM job_map
        UNION ALL SELECT session_id, 'skill', id, canonical_id FROM skill_map
        UNION ALL SELECT session_id, 'education', id, canonical_id FROM edu_map
        UNION ALL SELECT session_id, 'certification', id, canonical_id FROM cert_map""",
    "live_org": "SELECT r.* FROM raw_org r JOIN org_map m ON m.session_id = r.session_id AND m.id = org_id AND m.canonical_id = org_id QUALIFY row_number() OVER (PARTITION BY r.session_id, org_id ORDER BY doc_id, pos) = 1",
    "live_skill": "SELECT r.* FROM raw_skill r JOIN skill_map m ON m.session_id = r.session_id AND m.id = skill_id AND m.canonical_id = skill_id",
    "live_job": """
        SELECT r.* REPLACE (coalesce(o.canonical_id, r.org_id) AS org_id) FROM job r JOIN job_map m ON m.session_id = r.session_id AND m.id = job_id AND m.canonical_id = job_id
        LEFT JOIN org_map o ON o.session_id = r.session_id AND o.id = r.org_id""",
    "live_edu": """
        SELECT r.* REPLACE (coalesce(o.canonical_id, r.institution_id) AS institution_id) FROM raw_edu r JOIN edu_map m ON m.session_id = r.session_id AND m.id = edu_id AND m.canonical_id = edu_id
        LEFT JOIN org_map o ON o.session_id = r.session_id AND o.id = r.institution_id""",
    "live_cert": "SELECT r.* FROM raw_cert r JOIN cert_map m ON m.session_id = r.session_id AND m.id = cert_id AND m.canonical_id = cert_id",
    "usage": """
        SELECT b.session_id, b.job_id, coalesce(s.canonical_id, b.skill_id) AS skill_id, kind
        FROM job_skill b JOIN job_map m ON m.session_id = b.session_id AND m.id = b.job_id AND m.canonical_id = b.job_id
        LEFT JOIN skill_map s ON s.session_id = b.session_id AND s.id = b.skill_id""",
    "alt_label": "SELECT r.session_id, m.canonical_id AS skill_id, unnest(alt_labels) AS label FROM raw_skill r JOIN skill_map m ON m.session_id = r.session_id AND m.id = skill_id",
    "person_edge": """
        SELECT DISTINCT r.session_id, person_id, r.kind, canonical_id FROM merged_refs r
        JOIN id_maps m ON m.session_id = r.session_id AND m.kind = r.kind AND m.id = r.id""",
    "triple": " UNION ".join(
        [
            _cells("live_org", "org_id", *_base("organization", "name"), _lit(V.NAME, "name"), _lit(ONT + "organizationType", "org_type")),
            _cells(
                "live_skill", "skill_id", *_base("skill", "label"), _iri(V.EXACT_MATCH, "skos_uri"), _lit(V.CATEGORY, "category"),
                _lit(V.PROFICIENCY, "proficiency_level"), _lit(V.YEARS, "years_experience", V.XSD_DOUBLE),
            ),
            _many("live_skill", "skill_id", V.BROADER, "broader_concepts", True),
            _many("live_skill", "skill_id", V.NARROWER, "narrower_concepts", True),
            _many("(SELECT session_id, skill_id, [label] AS l FROM alt_label)", "skill_id", V.ALT_LABEL, "l", False),
            _cells(
                "live_job", "job_id", *_base("job", "title"), _lit(V.TITLE, "title"), _lit(V.START, "start_date", V.XSD_DATE),
                _lit(V.END, "end_date", V.XSD_DATE), _lit(V.IS_CURRENT, "is_current", V.XSD_BOOLEAN), _iri(V.HIRING_ORG, _mint("org_id")),
            ),
            _many("live_job", "job_id", V.ACHIEVEMENT, "achievements", False),
            f"SELECT session_id, {_mint('job_id')}, CASE kind WHEN 'skill' THEN '{V.USED_SKILL}' ELSE '{V.USED_TECH}' END, {_mint('skill_id')}, 'iri', NULL FROM usage",
            _cells(
                "live_edu", "edu_id", *_base("education", "label"), _lit(V.DEGREE, "degree_type"), _lit(V.FIELD, "field_of_study"),
                _lit(V.IS_CURRENT, "'false'", V.XSD_BOOLEAN), _iri(V.RECOGNIZED_BY, _mint("institution_id")),
            ),
            _cells(
                "live_cert", "cert_id", *_base("certification", "name"), _lit(V.NAME, "name"), _lit(ONT + "issuingOrganization", "issuing_organization"),
                _lit(ONT + "issueDate", "issue_date", V.XSD_DATE), _lit(ONT + "expirationDate", "expiration_date", V.XSD_DATE),
                _lit(ONT + "isActive", "'true'", V.XSD_BOOLEAN), _lit(ONT + "isExpired", "expiration_date < DATE '2001-01-01'", V.XSD_BOOLEAN),
            ),
            _cells("lead_person", "person_id", *_base("person", "name"), _lit(V.NAME, "name"), _lit(V.EMAIL, "email"), _lit(V.ADDRESS, "location")),
            f"SELECT session_id, {_mint('person_id')}, CASE kind WHEN 'job' THEN '{V.HAS_JOB}' WHEN 'skill' THEN '{V.HAS_SKILL}' WHEN 'education' THEN '{V.ALUMNI_OF}' ELSE '{V.HAS_CERT}' END, {_mint('canonical_id')}, 'iri', NULL FROM person_edge",
        ]
    ),
    "edge": f"""
        SELECT session_id, s AS source, o AS target, p, {_case('p', V.PREDICATE_LABEL, _local('p'))} AS label, {_case('p', V.EDGE_CLASS, "'other'")} AS edge_class
        FROM triple WHERE {_IS_EDGE}""",
    "node": f"""
        SELECT session_id, id, coalesce(pref, name, title, url_decode(replace({_local('id')}, '+', '%2B'))) AS label,
               coalesce(kind, 'unknown') AS kind, coalesce(TRY_CAST(conf AS DOUBLE), 1.0) AS confidence, title, email, address, org, category, proficiency, degree, field
        FROM (SELECT session_id, id, min(CASE WHEN p = '{V.RDF_TYPE}' THEN {_TYPE_NAME} END) AS kind,
                     {', '.join(f"min(CASE WHEN p = '{p}' THEN o END) AS {n}" for n, p in dict(pref=V.PREF_LABEL, name=V.NAME, title=V.TITLE, conf=V.CONFIDENCE, email=V.EMAIL, address=V.ADDRESS, org=V.HIRING_ORG, category=V.CATEGORY, proficiency=V.PROFICIENCY, degree=V.DEGREE, field=V.FIELD).items())}
              FROM (SELECT session_id, s AS id, p, o FROM triple UNION ALL SELECT session_id, o, NULL, NULL FROM triple WHERE {_IS_EDGE})
              GROUP BY 1, 2)""",
    "typed": f"SELECT DISTINCT session_id, s FROM triple WHERE p = '{V.RDF_TYPE}'",
    # ------------------------------------------------------------ labels
    "label": """
        SELECT session_id, pool, label, max(declared) AS declared, max(verified) AS verified, min(uri) AS uri FROM (
            SELECT session_id, 'skill' AS pool, url_decode(replace(label, '+', '%2B')) AS label, true AS declared, user_verified AS verified, skos_uri AS uri FROM raw_skill WHERE declared
            UNION ALL SELECT session_id, 'skill', url_decode(replace(label, '+', '%2B')), false, false, NULL FROM raw_tech
            UNION ALL SELECT session_id, 'org', url_decode(replace(name, '+', '%2B')), false, false, NULL FROM raw_org
            UNION ALL SELECT session_id, 'degree', url_decode(replace(degree_type, '+', '%2B')), false, false, NULL FROM raw_edu)
        WHERE trim(label) <> '' GROUP BY 1, 2, 3""",
    "label_case": """
        SELECT session_id, pool, label, declared, verified, uri, first_value(label) OVER (PARTITION BY session_id, pool, lower(trim(label))
               ORDER BY NOT (upper(label[1]) = label[1] AND lower(label[1]) <> label[1]), -length(label), label) AS c1
        FROM label""",
    "label_uri": """
        SELECT session_id, label AS c1, min(label) OVER (PARTITION BY session_id, uri) AS c2
        FROM label_case WHERE pool = 'skill' AND uri IS NOT NULL AND label = c1""",
    "alias_group": """
        SELECT session_id, 'LARGE ' || upper(w) AS canonical, ['small ' || w, 'SMALL ' || upper(w), 'large ' || w, 'LARGE ' || upper(w)] AS members
        FROM (SELECT DISTINCT session_id, split_part(p_name, ' ', -1) AS w FROM line)
        UNION ALL
        SELECT session_id, 'RED ' || upper(w), ['large ' || w, 'LARGE ' || upper(w), 'blue ' || w, 'BLUE ' || upper(w), 'red ' || w, 'RED ' || upper(w)]
        FROM (SELECT DISTINCT session_id, split_part(p_name, ' ', -1) AS w FROM line)""",
    "alias": """
        SELECT session_id, m AS label, min(canonical) AS canonical FROM (SELECT session_id, canonical, unnest(members) AS m FROM alias_group)
        WHERE m <> canonical GROUP BY 1, 2""",
    "label_map": """
        SELECT a.session_id, a.pool, a.label, CASE WHEN a.verified THEN a.label ELSE coalesce(y.canonical, x.canonical, u.c2, a.c1) END AS canonical,
               CASE WHEN a.verified THEN 'verified' WHEN x.canonical IS NOT NULL THEN 'alias' WHEN u.c2 <> a.c1 THEN 'uri' WHEN a.c1 <> a.label THEN 'case' ELSE 'none' END AS phase
        FROM label_case a
        LEFT JOIN label_uri u ON a.pool = 'skill' AND u.session_id = a.session_id AND u.c1 = a.c1
        LEFT JOIN alias x ON a.pool = 'skill' AND x.session_id = a.session_id AND x.label = coalesce(u.c2, a.c1)
        LEFT JOIN alias y ON a.pool = 'skill' AND y.session_id = a.session_id AND y.label = x.canonical""",
    # ------------------------------------------------------------ careers
    "person": "SELECT c_custkey AS session_id, c_name AS person_name, 'customer-' || c_custkey || '.md' AS source_document, regexp_extract(trim(c_name), '^(\\S+)', 1) AS name FROM customer",
    "skill": f"""
        SELECT session_id, replace(p_name, ' ', '-') AS skill_id, p_name AS label, nullif(min(p_type), 'PROMO') AS category, min(p_brand) AS proficiency_level,
               {_uri('p_name')} AS skos_uri,
               CASE WHEN max(p_size) >= 25 THEN [split_part(p_name, ' ', -1)] ELSE CAST([] AS VARCHAR[]) END AS broader_concepts,
               CASE WHEN max(p_size) % 7 = 0 THEN ['fine_' || split_part(p_name, ' ', -1), 'coarse_' || split_part(p_name, ' ', -1)] ELSE CAST([] AS VARCHAR[]) END AS narrower_concepts
        FROM line WHERE flag = 'R' GROUP BY session_id, p_name""",
    "tech_ref": f"""
        SELECT session_id, job_id, CASE variant WHEN 0 THEN '{RES}' || replace(p_name, ' ', '-') WHEN 1 THEN replace(p_name, ' ', '-') ELSE p_name END AS ref
        FROM line WHERE flag <> 'R'""",
    "tech": """
        SELECT session_id, job_id, lower(label) AS tech_key, min(label) AS label FROM (
            SELECT r.session_id, r.job_id, coalesce(s.label, CASE WHEN NOT starts_with(ref, 'urn:') THEN ref END) AS label
            FROM tech_ref r LEFT JOIN skill s ON s.session_id = r.session_id
                 AND s.skill_id = CASE WHEN starts_with(ref, 'urn:') THEN split_part(ref, '/', -1) ELSE ref END)
        WHERE label IS NOT NULL GROUP BY 1, 2, 3""",
    "gap": """
        SELECT coalesce(c.session_id, u.session_id) AS session_id, coalesce(c.key, u.key) AS key, coalesce(c.label, u.label) AS label,
               CASE WHEN u.key IS NULL THEN 'claimed_only' WHEN c.key IS NULL THEN 'used_only' ELSE 'both' END AS status,
               coalesce(u.n, 0) AS n_roles, c.category, c.proficiency_level
        FROM (SELECT session_id, lower(label) AS key, label, category, proficiency_level FROM skill) c
        FULL JOIN (SELECT session_id, tech_key AS key, min(label) AS label, count(*) AS n FROM tech GROUP BY 1, 2) u
        ON c.session_id = u.session_id AND c.key = u.key""",
    "spread": "SELECT session_id, tech_key, min(label) AS label, count(DISTINCT job_id) AS n_jobs, CASE WHEN count(DISTINCT job_id) > 1 THEN 'bridge' ELSE 'island' END AS role FROM tech GROUP BY 1, 2",
    "ordered_job": """
        SELECT *, coalesce(strftime(start_date, '%Y-%m-%d'), '0000') || '|' || job_id AS ord, strftime(start_date, '%Y-%m-%d') AS st,
               coalesce(strftime(end_date, '%Y-%m-%d'), 'present') AS en FROM job""",
    "step": """
        SELECT * FROM (SELECT session_id, ord, lag(job_id) OVER w AS from_job, lag(title) OVER w AS from_title, job_id AS to_job, title AS to_title
                       FROM ordered_job WINDOW w AS (PARTITION BY session_id ORDER BY ord)) WHERE from_job IS NOT NULL""",
    "transition": """
        SELECT s.session_id, s.ord, from_job, from_title, to_job, to_title, t.tech_key, CASE WHEN p.tech_key IS NULL THEN 'gained' ELSE 'retained' END AS change
        FROM step s JOIN tech t ON t.session_id = s.session_id AND t.job_id = s.to_job
        LEFT JOIN tech p ON p.session_id = s.session_id AND p.job_id = s.from_job AND p.tech_key = t.tech_key
        UNION ALL
        SELECT s.session_id, s.ord, from_job, from_title, to_job, to_title, p.tech_key, 'lost'
        FROM step s JOIN tech p ON p.session_id = s.session_id AND p.job_id = s.from_job
        WHERE NOT EXISTS (SELECT 1 FROM tech t WHERE t.session_id = s.session_id AND t.job_id = s.to_job AND t.tech_key = p.tech_key)""",
    "isolated": """
        SELECT session_id, job_id, title, ord FROM ordered_job j WHERE NOT EXISTS (
            SELECT 1 FROM tech a JOIN tech b ON a.session_id = b.session_id AND a.tech_key = b.tech_key AND a.job_id <> b.job_id
            WHERE a.session_id = j.session_id AND a.job_id = j.job_id)""",
    "link": """
        SELECT session_id, skill_id, label, 'includes' AS direction, replace(url_decode(unnest(narrower_concepts)), '_', ' ') AS name FROM skill
        UNION ALL SELECT session_id, skill_id, label, 'falls under', replace(url_decode(unnest(broader_concepts)), '_', ' ') FROM skill""",
    # ------------------------------------------------------------ taxonomy
    "taxonomy": """
        SELECT 'urn:skill:' || md5(p_name) AS concept_uri, p_name AS pref_label,
               CASE WHEN f NOT IN ('hot', 'cold') THEN 'urn:group:' || l END AS broader_uri,
               CASE WHEN f = 'red' THEN 'handle ' || p_name WHEN f NOT IN ('hot', 'cold') THEN l || ' handling' END AS broader_label,
               CASE WHEN f <> 'cold' THEN 'urn:pillar:1' END AS hierarchy_uri, CASE WHEN f <> 'cold' THEN 'manufacturing' END AS hierarchy_label
        FROM (SELECT DISTINCT p_name, split_part(p_name, ' ', 1) AS f, split_part(p_name, ' ', -1) AS l FROM part) WHERE f <> 'old'""",
    "tax_label": """
        SELECT DISTINCT unnest([p_name, split_part(p_name, ' ', -1), lower(p_type), split_part(p_name, ' ', 1) || ' work', p_name[1:2]]) AS label FROM part""",
    "candidate": """
        SELECT * FROM (SELECT label, concept_uri, pref_label, CASE WHEN length(label) < 2 THEN 0 WHEN starts_with(lower(pref_label), lower(label)) THEN 3
                    WHEN contains(lower(pref_label), lower(label)) THEN 2 WHEN split_part(lower(label), ' ', 1) = split_part(lower(pref_label), ' ', 1) THEN 1 ELSE 0 END AS score
        FROM tax_label CROSS JOIN taxonomy) WHERE score > 0""",
    "best": "SELECT label, concept_uri, pref_label AS preferred_label, score FROM candidate QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, pref_label, concept_uri) = 1",
    "broader": """
        SELECT b.*, coalesce(broader_uri, hierarchy_uri) AS broader_uri, CASE WHEN broader_uri IS NOT NULL THEN broader_label ELSE hierarchy_label END AS broader_label
        FROM best b JOIN taxonomy USING (concept_uri)""",
    "uncircular": """
        SELECT label, concept_uri, preferred_label, CASE WHEN c THEN NULL ELSE broader_uri END AS broader_uri, CASE WHEN c THEN NULL ELSE broader_label END AS broader_label
        FROM (SELECT *, coalesce(len(list_intersect(string_split(lower(label), ' '), string_split(lower(broader_label), ' ')))
                       / greatest(len(list_distinct(string_split(lower(label), ' '))), len(list_distinct(string_split(lower(broader_label), ' ')))) >= 0.6, false) AS c
              FROM broader)""",
    "grouped": """
        SELECT s.*, CASE WHEN x.f = 'red' THEN NULL ELSE x.g END AS broader_label
        FROM skill s LEFT JOIN (SELECT pref_label, split_part(pref_label, ' ', 1) AS f, coalesce(broader_label, hierarchy_label) AS g FROM taxonomy) x ON x.pref_label = s.label""",
    # ------------------------------------------------------------ evaluation
    "eval_org": r"""SELECT session_id, regexp_replace(trim(regexp_replace(lower(name), '[,.]?\s*(inc|llc|ltd|corp|co)\.?$', ''), ' ,.'), '^the ', '') AS key, pos FROM raw_org""",
    "got": """
        SELECT DISTINCT session_id AS doc_id, 'skills' AS etype, p_name AS key FROM line WHERE flag IN ('N', 'R')
        UNION SELECT session_id, 'jobs', lower(title) FROM job WHERE status <> 'O'
        UNION SELECT session_id, 'education', lower(degree_type) || '|' || lower(field_of_study) FROM raw_edu WHERE session_id % 3 <> 0
        UNION SELECT session_id, 'certifications', lower(name) FROM raw_cert WHERE pos % 3 <> 0
        UNION SELECT session_id, 'organizations', key FROM eval_org WHERE pos % 3 <> 0""",
    "want": """
        SELECT DISTINCT session_id AS doc_id, 'skills' AS etype, p_name AS key FROM line WHERE flag IN ('A', 'R')
        UNION SELECT session_id, 'jobs', lower(title) FROM job WHERE status <> 'P'
        UNION SELECT session_id, 'education', lower(degree_type) || '|' || lower(field_of_study) FROM raw_edu WHERE session_id % 3 <> 1
        UNION SELECT session_id, 'certifications', lower(name) FROM raw_cert WHERE pos % 3 <> 1
        UNION SELECT session_id, 'organizations', key FROM eval_org WHERE pos % 3 <> 1""",
    "detail": """
        SELECT coalesce(g.doc_id, w.doc_id) AS doc_id, coalesce(g.etype, w.etype) AS etype, coalesce(g.key, w.key) AS key,
               CASE WHEN g.key IS NULL THEN 'missing' WHEN w.key IS NULL THEN 'unexpected' ELSE 'matched' END AS status
        FROM got g FULL JOIN want w ON g.doc_id = w.doc_id AND g.etype = w.etype AND g.key = w.key""",
    # ------------------------------------------------------------ uploads and feeds
    "upload": """
        SELECT source AS session_id, doc_id AS document_id, 'file' || doc_id || CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.md' WHEN 'de' THEN '.PDF' ELSE '.exe' END AS filename,
               TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS upload_ts, md5(text) AS file_hash FROM documents""",
    "event": """
        SELECT event_id, ts, 'src' || user_id % 20 AS session_id, user_id AS document_id,
               CASE event_type WHEN 'signup' THEN 'started' WHEN 'view' THEN 'progress' WHEN 'click' THEN 'entity_extracted' WHEN 'purchase' THEN 'complete' ELSE 'error' END AS event,
               CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'complete' ELSE 'error' END AS status, props AS payload
        FROM events""",
    "doc_status": """
        SELECT session_id, document_id, last(status ORDER BY ts, event_id) AS status, max(ts) AS last_ts, count(*) AS n_events FROM event GROUP BY 1, 2""",
    "session": "SELECT session_id, max(ts) AS updated_at FROM event GROUP BY 1 UNION ALL SELECT 'n' || n_nationkey, TIMESTAMP '2023-01-01' FROM nation",
}

_WORD = re.compile(r"\b[a-z_]+\b")


def variant(prefix: str, **replaced: str) -> None:
    """Add blocks ``prefix + name`` for the replaced ones and for all that depend on them, but for the labels themselves."""
    touched = set(replaced)
    for name, sql in BLOCKS.items():
        if set(_WORD.findall(sql)) & touched and name not in replaced and name != "label":
            touched.add(name)
    swap = lambda sql: _WORD.sub(lambda m: prefix + m[0] if m[0] in touched else m[0], sql)
    new = {prefix + n: replaced[n] if n in replaced else swap(BLOCKS[n]) for n in list(BLOCKS) if n in touched}
    BLOCKS.update(new)


# The graph of a session whose labels were reconciled before it was built.
variant(
    "n_",
    raw_skill="""
        SELECT r.* EXCLUDE (d) REPLACE (CASE WHEN user_verified THEN r.label ELSE coalesce(m.canonical, d) END AS label,
               CASE WHEN user_verified OR coalesce(m.canonical, d) = d OR list_contains(alt_labels, d) THEN alt_labels ELSE list_append(alt_labels, d) END AS alt_labels)
        FROM (SELECT *, url_decode(replace(label, '+', '%2B')) AS d FROM raw_skill) r
        LEFT JOIN label_map m ON m.session_id = r.session_id AND m.pool = 'skill' AND m.label = d""",
    raw_org="""
        SELECT o.* REPLACE (coalesce(m.canonical, o.name) AS name)
        FROM raw_org o LEFT JOIN label_map m ON m.session_id = o.session_id AND m.pool = 'org' AND m.label = o.name""",
    raw_edu="""
        SELECT e.* REPLACE (coalesce(m.canonical, e.degree_type) AS degree_type)
        FROM raw_edu e LEFT JOIN label_map m ON m.session_id = e.session_id AND m.pool = 'degree' AND m.label = e.degree_type""",
)


def compose(query: str) -> str:
    """The query with the blocks it needs in front, in definition order."""
    need: set[str] = set()

    def visit(sql: str) -> None:
        for name in set(_WORD.findall(sql)) & BLOCKS.keys() - need:
            need.add(name)
            visit(BLOCKS[name])

    visit(query)
    if not need:
        return query
    # A recursive block can't be materialised; the others are computed once.
    once = lambda n: "" if re.search(rf"\b{n}\b", BLOCKS[n]) else "MATERIALIZED "
    blocks = ",\n".join(f"{n} AS {once(n)}({BLOCKS[n]})" for n in BLOCKS if n in need)
    return f"WITH RECURSIVE {blocks}\n{query}"
