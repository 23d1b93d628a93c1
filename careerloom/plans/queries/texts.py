"""Rendered insights, prompts and exports.

The SQL builds the same texts line by line from its own joins.
"""

import re

from pyspark.sql import functions as F

from careerloom import vocab as V
from careerloom.operators.sessions import ANALYSIS_TYPES
from careerloom.plans import insights as I
from careerloom.plans import prompts as P
from careerloom.plans import render as R
from careerloom.plans import texts as TX
from careerloom.plans.queries.registry import query
from careerloom.runtime import cut
from careerloom.sources import to_jsonld, to_ntriples


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _f(template: str, **cols: str) -> str:
    """A template as SQL concatenation."""
    parts = [
        f"CAST({cols[p[1:-1]]} AS VARCHAR)" if re.fullmatch(r"\{\w+\}", p) else _q(p)
        for p in re.split(r"(\{\w+\})", template)
        if p
    ]
    return "(" + " || ".join(parts) + ")"


def _l(sec, line, source, a="''", b="''", seq=0, where="true"):
    return f"SELECT session_id, {sec} AS sec, {a} AS a, {b} AS b, {seq} AS seq, {line} AS line FROM {source} WHERE {where}"


def _h(sec, source, *texts):
    """Fixed lines for every person that occurs in ``source``."""
    src = f"(SELECT p.session_id, p.name FROM person p WHERE p.session_id IN (SELECT session_id FROM {source}))"
    return [_l(sec, t if t.startswith("(") else _q(t), src, seq=i) for i, t in enumerate(texts)]


def _doc(*parts) -> str:
    flat = [x for p in parts for x in (p if isinstance(p, list) else [p])]
    return f"SELECT session_id, string_agg(line, chr(10) ORDER BY sec, a, b, seq) AS content FROM ({' UNION ALL '.join(flat)}) GROUP BY 1"


_GAP = _doc(
    _l(
        0,
        _f(TX.GAP_HEAD, name="name", claimed="coalesce(c, 0)", used="coalesce(u, 0)", both="coalesce(o, 0)", overlap="coalesce(ov, 'none')"),
        """(SELECT * FROM person LEFT JOIN (SELECT session_id, count(*) FILTER (status <> 'used_only') AS c, count(*) FILTER (status <> 'claimed_only') AS u, count(*) FILTER (status = 'both') AS o,
            string_agg(label, ', ' ORDER BY label) FILTER (status = 'both') AS ov FROM gap GROUP BY 1) USING (session_id))""",
    ),
    _l(0, "''", "person", seq=1),
    _h(1, "gap WHERE status = 'used_only'", "## Undersold Capabilities", "", _f(TX.GAP_USED, name="name"), ""),
    *[
        _l(2, line, "(SELECT DISTINCT j.session_id, ord, title, st, en FROM ordered_job j JOIN tech t ON t.job_id = j.job_id JOIN gap g ON g.session_id = t.session_id AND g.key = t.tech_key AND g.status = 'used_only')", a="ord", b=b)
        for line, b in ((_f("**{t} ({s}–{e})**", t="title", s="st", e="en"), "''"), ("''", "'~'"))
    ],
    _l(2, "'- ' || label", "(SELECT j.session_id, ord, t.label FROM ordered_job j JOIN tech t ON t.job_id = j.job_id JOIN gap g ON g.session_id = t.session_id AND g.key = t.tech_key AND g.status = 'used_only')", a="ord", b="'t' || label"),
    _h(3, "gap WHERE status = 'claimed_only'", "## Ungrounded Claims", "", TX.GAP_CLAIMED, ""),
    _l(4, _f("- **{l}** — {c}, {p}", l="label", c="coalesce(category, '?')", p="coalesce(proficiency_level, 'unrated')"), "gap", a="label", where="status = 'claimed_only'"),
)


@query("render_skill_gap", _GAP)
def _(c):
    c.store("line", "job", "skill", "tech")
    return R.assemble_text(R.render_skill_gap(c.persons, c.job, c.skill, c.tech))


_ARGS = dict(name="name", jobs="coalesce(n, 0)", techs="coalesce(t, 0)", bridges="coalesce(b, 0)", names="coalesce(ns, '')")
_TOPOLOGY = _doc(
    _l(
        0,
        f"CASE WHEN coalesce(b, 0) = 0 THEN {_f(TX.TOPOLOGY_NONE, **_ARGS)} WHEN b <= 2 THEN {_f(TX.TOPOLOGY_FEW, **_ARGS)} ELSE {_f(TX.TOPOLOGY_MANY, **_ARGS)} END",
        """(SELECT * FROM person LEFT JOIN (SELECT session_id, count(*) AS n FROM job GROUP BY 1) USING (session_id) LEFT JOIN (SELECT session_id, count(*) AS t, count(*) FILTER (role = 'bridge') AS b,
            string_agg(label, ', ' ORDER BY label) FILTER (role = 'bridge') AS ns FROM spread GROUP BY 1) USING (session_id))""",
    ),
    _l(0, "''", "person", seq=1),
    _h(1, "spread WHERE role = 'bridge'", "## Bridge Technologies", "", TX.TOPOLOGY_BRIDGES, ""),
    _l(
        2, _f("- **{t}** — connects: {r}", t="label", r="roles"),
        """(SELECT s.session_id, s.label, string_agg(title, ' and ' ORDER BY ord) AS roles FROM spread s JOIN tech t ON t.session_id = s.session_id AND t.tech_key = s.tech_key
            JOIN ordered_job j ON j.job_id = t.job_id WHERE s.role = 'bridge' GROUP BY 1, 2)""",
        a="label",
    ),
    _h(3, "spread WHERE role = 'bridge'", ""),
    _h(4, "isolated", "## Isolated Roles", "", TX.TOPOLOGY_ISOLATED, ""),
    _l(5, "'- ' || title", "isolated", a="ord"),
    _h(6, "isolated", "", _f(TX.TOPOLOGY_MEANING, name="name")),
)


@query("render_topology", _TOPOLOGY)
def _(c):
    c.store("line", "job", "skill", "tech")
    return R.assemble_text(R.render_topology(c.persons, c.job, c.tech))


_HEADING = _f("### {t} ({s} – {e}){c}", t="title", s="st", e="en", c=f"CASE WHEN is_current THEN '{TX.CURRENT}' ELSE '' END")
_JOBS_PER = "(SELECT * FROM person LEFT JOIN (SELECT session_id, count(*) AS n FROM job GROUP BY 1) USING (session_id))"
_EVOLUTION = _doc(
    _l(0, _f(TX.EVOLUTION_HEAD, name="name", jobs="coalesce(n, 0)"), _JOBS_PER),
    *[_l(0, _q(t), "person", seq=i + 1) for i, t in enumerate(("", "## Chronological Technology Timeline", ""))],
    _l(1, _HEADING, "ordered_job", a="ord"),
    _l(
        1, f"'**Tools:** ' || coalesce(tools, '{TX.NO_TOOLS}')",
        "(SELECT j.session_id, ord, tools FROM ordered_job j LEFT JOIN (SELECT session_id, job_id, string_agg(label, ', ' ORDER BY label) AS tools FROM tech GROUP BY 1, 2) USING (session_id, job_id))",
        a="ord", seq=1,
    ),
    _l(1, "''", "ordered_job", a="ord", seq=2, where="len(achievements) > 0"),
    _l(1, "'- ' || achievements[i]", "(SELECT session_id, ord, achievements, unnest(range(1, len(achievements) + 1)) AS i FROM ordered_job)", a="ord", b="'00000000' || (i - 1)"),
    _l(1, "''", "ordered_job", a="ord", b="'~'"),
    _h(2, "step", "## Transition Analysis", ""),
    _l(3, _f("**{x} → {y}**", x="from_title", y="to_title"), "step", a="ord"),
    _l(
        3, "CASE change WHEN 'retained' THEN '- *Retained:* ' WHEN 'gained' THEN '- *Gained:* ' ELSE '- *Dropped:* ' END || keys",
        "(SELECT session_id, ord, change, string_agg(tech_key, ', ' ORDER BY tech_key) AS keys FROM transition GROUP BY 1, 2, 3)",
        a="ord", b="CASE change WHEN 'retained' THEN '1' WHEN 'gained' THEN '2' ELSE '3' END",
    ),
    _l(3, "''", "step", a="ord", b="'~'"),
)


@query("render_evolution", _EVOLUTION)
def _(c):
    c.store("line", "job", "skill", "tech")
    return R.assemble_text(R.render_evolution(c.persons, c.job, c.tech))


def _n(c: str) -> str:
    return f"{c} || CASE WHEN {c} = 1 THEN ' skill' ELSE ' skills' END"


_KEYED = "label || '|' || skill_id"
_CATS = "(SELECT session_id, coalesce(category, 'Uncategorized') AS cat, count(*) AS n, string_agg(label, ', ' ORDER BY label) AS labels FROM skill GROUP BY 1, 2)"
_GROUPS = "(SELECT session_id, broader_label AS g, count(*) AS n FROM grouped WHERE broader_label IS NOT NULL GROUP BY 1, 2)"
_HIERARCHY = _doc(
    _l(
        0,
        _f(TX.HIERARCHY_HEAD, name="name", total="coalesce(t, 0)", matched="coalesce(m, 0)", pct="coalesce(m * 100 // t, 0)", unmatched="coalesce(t - m, 0)"),
        "(SELECT * FROM person LEFT JOIN (SELECT session_id, count(*) AS t, count(broader_label) AS m FROM grouped GROUP BY 1) USING (session_id))",
    ),
    _l(0, "''", "person", seq=1),
    _h(1, "link", "## Explicit SKOS Hierarchy", ""),
    _l(
        2, _f("- **{l}** → {d}: {n}", l="label", d="direction", n="names"),
        "(SELECT session_id, skill_id, label, direction, string_agg(name, ', ' ORDER BY name) AS names FROM link GROUP BY 1, 2, 3, 4)",
        a=_KEYED, b="CASE direction WHEN 'includes' THEN '1' ELSE '2' END",
    ),
    _h(3, "link", ""),
    _h(4, _GROUPS, "## Skills by ESCO Category", "", TX.HIERARCHY_GROUPS, ""),
    _l(5, f"'**' || g || '** (' || {_n('n')} || ')'", _GROUPS, a="g"),
    _l(5, "''", _GROUPS, a="g", seq=1),
    _l(5, "'- ' || label", "grouped", a="broader_label", b=f"'t' || {_KEYED}", where="broader_label IS NOT NULL"),
    _l(5, "''", _GROUPS, a="g", b="'~'"),
    _h(6, "grouped WHERE broader_label IS NULL", "## Domain-Specific & Uncategorized Skills", "", TX.HIERARCHY_OTHER, ""),
    _l(7, "'- ' || label || CASE WHEN category IS NOT NULL THEN ' *(' || category || ')*' ELSE '' END", "grouped", a=_KEYED, where="broader_label IS NULL"),
    _h(8, "grouped WHERE broader_label IS NULL", ""),
    _h(9, "skill", "## By Extraction Category", "", TX.HIERARCHY_CATEGORIES, ""),
    _l(10, f"'**' || cat || '** (' || {_n('n')} || '): ' || labels", _CATS, a="cat"),
    _l(10, "''", _CATS, a="cat", seq=1),
)


@query("render_hierarchy", _HIERARCHY)
def _(c):
    c.store("skill", "matches")
    return R.assemble_text(R.render_hierarchy(c.persons, c.skill, c.matches))


_COVERAGE = _doc(
    _l(
        0, _f(TX.COVERAGE_HEAD, pct="coalesce(CAST(round_even(l / t * 100, 0) AS BIGINT), 0)", name="name", linked="coalesce(l, 0)", total="coalesce(t, 0)"),
        "(SELECT * FROM person LEFT JOIN (SELECT session_id, count(*) AS t, count(skos_uri) AS l FROM skill GROUP BY 1) USING (session_id))",
    ),
    _l(0, "''", "person", seq=1),
    _h(1, "skill WHERE skos_uri IS NOT NULL", "## Globally Identifiable Skills (ESCO-linked)", ""),
    _l(2, "'- **' || label || '**'", "skill", a=_KEYED, where="skos_uri IS NOT NULL"),
    _h(3, "skill WHERE skos_uri IS NOT NULL", ""),
    _h(4, "skill WHERE skos_uri IS NULL", "## String-Only Skills (not globally identifiable)", ""),
    _l(5, "'- ' || label || ' *(' || coalesce(category, '?') || ')*'", "skill", a=_KEYED, where="skos_uri IS NULL"),
    _h(6, "skill WHERE skos_uri IS NULL", "", _f(TX.COVERAGE_PATTERN, name="name")),
)


@query("render_coverage", _COVERAGE)
def _(c):
    c.store("skill")
    return R.assemble_text(R.render_coverage(c.persons, c.skill))


_TWICE = "(SELECT session_id, title FROM job GROUP BY 1, 2 HAVING count(*) > 1)"
_PROGRESSION = _doc(
    _l(
        0, f"CASE WHEN n > 0 THEN {_f(TX.PROGRESSION_HEAD, name='name', jobs='n', first='f', titles='u')} ELSE {_f(TX.PROGRESSION_EMPTY, name='name')} END",
        "(SELECT * FROM person LEFT JOIN (SELECT session_id, count(*) AS n, count(DISTINCT title) AS u, arg_min(st, ord) AS f FROM ordered_job GROUP BY 1) USING (session_id))",
    ),
    *[_l(0, _q(t), "person", seq=i + 1) for i, t in enumerate(("", "## Career Timeline", ""))],
    _l(1, _HEADING, "ordered_job", a="ord"),
    _l(1, "'- ' || x", "(SELECT session_id, ord, unnest(achievements[1:2]) AS x, unnest(range(len(achievements[1:2]))) AS i FROM ordered_job)", a="ord", b="CAST(i AS VARCHAR)"),
    _l(1, "''", "ordered_job", a="ord", b="'~'"),
    _h(2, _TWICE, "## Recurring Titles", ""),
    _l(3, _f(TX.PROGRESSION_TITLE, title="title"), _TWICE, a="title"),
    _h(4, _TWICE, ""),
    *[
        _l(5, line, "(SELECT session_id, count(*) AS n FROM (SELECT session_id, org_id FROM job WHERE org_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1)", seq=i)
        for i, line in enumerate(("'## Organizational Loyalty'", "''", _f(TX.PROGRESSION_LOYALTY, orgs="n")))
    ],
)


@query("render_progression", _PROGRESSION)
def _(c):
    c.store("job")
    return R.assemble_text(R.render_progression(c.persons, c.job))


_CONTENT = {
    "skill_gap": _GAP, "career_topology": _TOPOLOGY, "tech_evolution": _EVOLUTION,
    "hierarchy_map": _HIERARCHY, "esco_coverage": _COVERAGE, "role_progression": _PROGRESSION,
}
_DATE = "2001-01-01"
_META = """SELECT p.session_id, p.person_name, p.source_document, 1 + coalesce(j, 0) + coalesce(s, 0) AS entity_count, coalesce(j, 0) AS job_count, coalesce(s, 0) AS skill_count
    FROM person p LEFT JOIN (SELECT session_id, count(*) AS j FROM job GROUP BY 1) USING (session_id) LEFT JOIN (SELECT session_id, count(*) AS s FROM skill GROUP BY 1) USING (session_id)"""


def _packed(kind: str) -> str:
    return f"SELECT '{kind}' AS analysis_type, {_q(TX.INSIGHTS[kind][0])} AS title, m.*, d.content FROM ({_META}) m JOIN ({_CONTENT[kind]}) d USING (session_id)"


def _battery(c, types=None):
    c.store("persons", "line", "job", "skill", "tech", "matches")
    out, failed = I.run_battery(c.career_frames(), F.lit(_DATE), types, buckets=c.buckets)
    if failed:
        raise RuntimeError(f"analyses failed: {failed}")
    return out


@query(
    "package_insight",
    " UNION ALL ".join(
        f"""SELECT session_id, analysis_type, title, content, source_document AS source_file, person_name, '{_DATE}' AS analysis_date,
        {_q('|'.join(TX.INSIGHTS[k][1]))} AS tags, {_q('|'.join(TX.INSIGHTS[k][2]))} AS query_hints, entity_count, job_count, skill_count
        FROM ({_packed(k)})"""
        for k in ANALYSIS_TYPES
    ),
)
def _(c):
    return _battery(c).withColumn("tags", F.array_join("tags", "|")).withColumn("query_hints", F.array_join("query_hints", "|"))


@query(
    "run_battery",
    "SELECT session_id, analysis_type, title, content FROM (" + " UNION ALL ".join(_packed(k) for k in ANALYSIS_TYPES) + ")",
)
def _(c):
    return _battery(c).select("session_id", "analysis_type", "title", "content")


@query(
    "insight_lines",
    " UNION ALL ".join(
        f"SELECT session_id, '{k}' AS analysis_type, unnest(string_split(content, chr(10))) AS line FROM ({_CONTENT[k]})" for k in ANALYSIS_TYPES
    ),
)
def _(c):
    c.store("line", "job", "skill", "tech", "matches")
    # A line that holds a line break is two lines of the text.
    lines = I.insight_lines(c.career_frames())
    return lines.select("session_id", "analysis_type", F.explode(F.split("line", "\n")).alias("line"))


def _yaml(kind: str) -> str:
    title, tags, hints = TX.INSIGHTS[kind]
    items = lambda xs: [f'  - "{x}"' for x in xs]
    head = "\n".join(["---", f"analysis_type: {kind}", f'title: "{title}"', "source_file: "])
    mid = "\n".join(["", f"analysis_date: {_DATE}", "tags:", *items(tags), "query_hints:", *items(hints), "entity_count: "])
    return (
        f"{_q(head)} || source_document || {_q(chr(10) + 'person_name: ')} || person_name || {_q(mid)} || entity_count || {_q(chr(10) + 'job_count: ')} || job_count || "
        f"{_q(chr(10) + 'skill_count: ')} || skill_count || {_q(chr(10).join(['', '---', '', '# ' + title, '', '']))} || content"
    )


@query("to_markdown", " UNION ALL ".join(f"SELECT session_id, analysis_type, {_yaml(k)} AS markdown FROM ({_packed(k)})" for k in ANALYSIS_TYPES))
def _(c):
    return I.to_markdown(_battery(c))


_ENTRY = "session_id || ':' || analysis_type AS id, content AS document, analysis_type, title, source_document AS source_file, person_name, '2001-01-01' AS analysis_date, 'graph_analysis' AS source"


_ENTRIES = " UNION ALL ".join(f"SELECT {_ENTRY} FROM ({_packed(k)})" for k in ANALYSIS_TYPES)


@query("retrieval_entries", _ENTRIES)
def _(c):
    return I.retrieval_entries(_battery(c))


@query("upsert_entries", _ENTRIES)
def _(c):
    """Half of the analyses are outdated and replaced, one is missing and added."""
    new = cut(I.retrieval_entries(_battery(c)))
    fresh = F.col("analysis_type").isin("role_progression", "skill_gap", "career_topology")
    old = new.filter(~fresh).unionByName(new.filter(fresh & (F.col("analysis_type") != "skill_gap")).withColumn("document", F.lit("outdated")))
    return I.upsert_entries(old, new.filter(fresh))


# ---------------------------------------------------------------- prompts



def _markdown(c):
    return I.to_markdown(_battery(c))


# All six analyses, each under its delimiter, without front matter and outer blanks.
_ANALYSES = "SELECT session_id, string_agg('═══ [' || k || '] ═══' || chr(10) || body, chr(10) || chr(10) ORDER BY o) AS a FROM (" + " UNION ALL ".join(
    f"SELECT session_id, {o} AS o, '{k}' AS k, regexp_replace('# ' || {_q(TX.INSIGHTS[k][0])} || chr(10) || chr(10) || content, '\\s+$', '') AS body FROM ({_CONTENT[k]})"
    for o, k in enumerate(ANALYSIS_TYPES)
) + ") GROUP BY 1"
_PROMPTS = " UNION ALL ".join(
    f"SELECT session_id, '{k}' AS variant, {_f(t, analyses='a')} AS prompt FROM ({_ANALYSES})" for k, t in P.SYNTHESIS_TEMPLATES.items()
)


@query("synthesis_prompts", _PROMPTS)
def _(c):
    return P.synthesis_prompts(_markdown(c))


def _lines(*lines: str) -> str:
    return " || chr(10) || ".join(lines)


_BULLETS = lambda items: [_q(f'  - "{x}"') for x in items]


@query(
    "narrative_documents",
    "SELECT session_id, variant, 'career_narrative_' || variant || '.md' AS filename, "
    + _lines(
        "'---'", "'analysis_type: career_narrative'", "'variant: ' || variant", "'synthesis: true'",
        "'title: \"Career Narrative — ' || upper(variant[1]) || variant[2:] || ' Synthesis\"'", "'person_name: ' || person_name",
        "'generated_at: 2001-02-03T04:05:06'", "'provider: none'", "'model: digest'", "'source_analyses:'", *_BULLETS(ANALYSIS_TYPES),
        "'tags:'", *_BULLETS(TX.NARRATIVE_TAGS), "'query_hints:'", *_BULLETS(TX.NARRATIVE_HINTS), "'---'", "''", "md5(prompt)", "''",
    )
    + f" AS markdown FROM ({_PROMPTS}) JOIN person USING (session_id) WHERE session_id % 5 <> 0",
)
def _(c):
    """Replies are the digests of the prompts; one person in five got none."""
    documents = cut(_markdown(c))
    prompts = P.synthesis_prompts(documents)
    replies = prompts.withColumn("response", F.when(F.col("session_id") % 5 != 0, F.md5("prompt")).otherwise(" "))
    return P.narrative_documents(replies, documents, "none", "digest", F.lit("2001-02-03 04:05:06").cast("timestamp_ntz"))


@query("person_name_fallback", "SELECT session_id, CASE WHEN session_id % 3 = 0 THEN 'the candidate' ELSE person_name END AS person_name FROM person")
def _(c):
    name = F.when(F.col("session_id") % 3 == 0, F.lit("None")).otherwise(F.concat(F.lit('"'), "person_name", F.lit('"')))
    docs = c.persons.select(
        "session_id", F.lit("skill_gap").alias("analysis_type"),
        F.concat(F.lit("---\ntitle: x\nperson_name: "), name, F.lit("\n---\n\nperson_names: none")).alias("markdown"),
    )
    return P.person_name_fallback(docs)


_CITED = """SELECT conv_id, turn, text || ' [' || role || ' + skill_gap] and [career_topology] or [skill_gap]' AS t, role FROM conversations"""


@query(
    "citation_audit",
    f"""SELECT conv_id, name, count(*) AS n, name IN ('skill_gap', 'career_topology') AS known FROM (
        SELECT conv_id, unnest([role, 'skill_gap', 'career_topology', 'skill_gap']) AS name FROM ({_CITED})) GROUP BY 1, 2""",
)
def _(c):
    text = F.concat("text", F.lit(" ["), "role", F.lit(" + skill_gap] and [career_topology] or [skill_gap]"))
    return P.citation_audit(c.t("conversations").select("conv_id", text.alias("text")), "conv_id", "text")


@query(
    "normalization_prompts",
    f"""SELECT session_id, pool, {_f(P.ALIAS_TEMPLATE.replace('{{', '<').replace('}}', '>'), what="CASE pool " + ' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in P.POOL_NAMES.items()) + " END", items='items').replace('<', '{').replace('>', '}')} AS prompt
        FROM (SELECT session_id, pool, string_agg('  - "' || label || '"' || CASE WHEN pool <> 'skill' THEN '' WHEN declared THEN ' [declared skill]' ELSE ' [used in job]' END, chr(10)
              ORDER BY NOT (declared OR pool <> 'skill'), label) AS items FROM label GROUP BY 1, 2)""",
)
def _(c):
    return P.normalization_prompts(c.labels)


@query("extraction_prompts", f"SELECT doc_id, md5({_f(P.EXTRACTION_TEMPLATE, text='text')}) AS prompt FROM documents")
def _(c):
    return P.extraction_prompts(c.t("documents").select("doc_id", "text")).withColumn("prompt", F.md5("prompt"))


@query(
    "parse_responses",
    f"""SELECT doc_id, CASE WHEN n % 4 = 3 THEN 'error' ELSE 'complete' END AS status, CASE WHEN n % 4 < 3 THEN 'P' || n END AS name, CASE WHEN n % 4 < 3 THEN 's' || n END AS skill
        FROM (SELECT doc_id, length(text) + {len(P.EXTRACTION_TEMPLATE) - len('{text}')} AS n FROM documents)""",
)
def _(c):
    """Replies in the forms that models give, by the length of the prompt: bare, fenced, in a sentence, cut off."""
    prompts = P.extraction_prompts(c.t("documents").select("doc_id", "text"))
    n = F.length("prompt")
    body = F.format_string('{"person": {"name": "P%d"}, "skills": [{"label": "s%d"}]}', n, n)
    reply = (
        F.when(n % 4 == 0, body)
        .when(n % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(n % 4 == 2, F.concat(F.lit("Sure: "), body, F.lit(" done")))
        .otherwise(F.left(body, F.length(body) - 2))
    )
    out = P.parse_responses(prompts.select("doc_id", reply.alias("response")))
    return out.select("doc_id", "status", F.col("person.name").alias("name"), F.try_element_at("skills.label", F.lit(1)).alias("skill"))


# ---------------------------------------------------------------- graph files

@query(
    "write_turtle",
    f"""SELECT session_id, '<' || s || '> <' || p || '> ' || CASE WHEN o_kind = 'iri' THEN '<' || o || '>' ELSE '"' || replace(replace(o, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"'
        || CASE WHEN o_type = '{V.XSD_STRING}' THEN '' ELSE '^^<' || o_type || '>' END END || ' .' AS line FROM triple""",
)
def _(c):
    return to_ntriples(c.triples)


@query(
    "write_jsonld",
    """SELECT session_id, s, count(DISTINCT p) + 1 AS n_keys, count(*) AS n_values FROM triple GROUP BY 1, 2""",
)
def _(c):
    nodes = to_jsonld(c.triples)
    keys = F.map_filter(F.from_json("node", "map<string,string>"), lambda k, v: k != "@id")
    values = F.aggregate(F.map_values(keys), F.lit(0).cast("long"), lambda a, v: a + F.json_array_length(v))
    return nodes.select("session_id", "s", (F.size(keys) + 1).cast("long").alias("n_keys"), values.alias("n_values"))


@query("jsonld_round_trip", "SELECT session_id, s, p, o, o_kind, o_type FROM triple")
def _(c):
    from careerloom.sources import jsonld_triples

    return jsonld_triples(to_jsonld(c.triples).select("session_id", "node"))
