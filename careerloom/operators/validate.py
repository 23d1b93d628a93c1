"""Data-quality rules over the triples of every session."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerloom import vocab as V
from careerloom.functions import alnum_key, strip
from careerloom.operators.common import KEY
from careerloom.runtime import cut_by

_KINDS = tuple(V.TYPE_IRI)


def _issue(level: str, check: str, subject: Column, message: Column) -> list[Column]:
    return [
        F.lit(level).alias("level"),
        F.lit(check).alias("check"),
        subject.alias("subject"),
        message.alias("message"),
    ]


def _local(p: Column) -> Column:
    return F.when(p.contains("#"), F.substring_index(p, "#", -1)).otherwise(F.substring_index(p, "/", -1))


# Predicates whose targets must be typed nodes: level and check of a breach.
REFERENCE_RULES = (
    (V.CORE_RELATIONS, "error", "dangling_reference"),
    (V.HIERARCHY_RELATIONS, "warning", "skos_dangling"),
    ((V.USED_TECH,), "warning", "technology_dangling"),
)


def dangling(triples: DataFrame, rules=REFERENCE_RULES, namespace: str = V.RES, facts: DataFrame | None = None) -> DataFrame:
    """Edges into our namespace whose target has no type; all rules in one anti join."""
    p = F.col("p")
    refs = triples.filter(
        p.isin(*[x for names, _, _ in rules for x in names]) & (F.col("o_kind") == "iri") & F.col("o").startswith(namespace)
    ).select(KEY, "s", "p", "o")
    typed = triples.filter(p == V.RDF_TYPE) if facts is None else facts.filter("typed")
    typed = typed.select(KEY, F.col("s").alias("o"))
    pick = lambda i: F.coalesce(*[F.when(p.isin(*r[0]), F.lit(r[i])) for r in rules])
    message = F.concat(_local(p), F.lit(" points at "), "o", F.lit(", which has no typed node in the graph"))
    return refs.join(typed, [KEY, "o"], "left_anti").select(
        KEY, pick(1).alias("level"), pick(2).alias("check"), F.col("s").alias("subject"), message.alias("message")
    )


def dangling_references(triples: DataFrame) -> DataFrame:
    return dangling(triples, REFERENCE_RULES[:1])


def hierarchy_dangling(triples: DataFrame) -> DataFrame:
    return dangling(triples, REFERENCE_RULES[1:2])


def technology_dangling(triples: DataFrame) -> DataFrame:
    return dangling(triples, REFERENCE_RULES[2:])


def node_facts(triples: DataFrame) -> DataFrame:
    """All per-node facts that the rules and counts need, one row per (session, s), in one aggregation."""
    p, o = F.col("p"), F.col("o")
    has = lambda iri: F.max(F.coalesce(p == iri, F.lit(False)))
    literal_label = (p == V.PREF_LABEL) & (F.col("o_kind") == "literal") & (strip("o") != "")
    return triples.groupBy(KEY, "s").agg(
        F.count("*").alias("n"),
        *[F.count_if((p == V.RDF_TYPE) & (o == iri)).alias(f"n_{k}") for k, iri in V.TYPE_IRI.items()],
        F.max(p == V.RDF_TYPE).alias("typed"),
        F.max(literal_label).alias("labelled"),
        F.min(F.when(p == V.PREF_LABEL, o)).alias("label"),
        has(V.HIRING_ORG).alias("has_org"),
        has(V.START).alias("has_start"),
        F.max(p.isin(V.USED_TECH, V.USED_SKILL)).alias("has_usage"),
    )


def node_rules(triples: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Missing labels, and jobs without organization, start date or technologies."""
    label = F.coalesce("label", "s")
    job = F.col("n_job") > 0
    known = sum((F.col(f"n_{k}") for k in _KINDS), F.lit(0)) > 0
    msg = lambda tail: F.concat(F.lit("Job '"), label, F.lit(tail))
    candidates = [
        (known & ~F.col("labelled"), "error", "missing_label",
         F.concat(F.lit("Entity "), "s", F.lit(" has no non-empty skos:prefLabel"))),
        (job & ~F.col("has_org"), "warning", "job_missing_organization", msg("' has no schema:hiringOrganization link")),
        (job & ~F.col("has_start"), "warning", "job_missing_dates", msg("' has no schema:startDate")),
        (job & ~F.col("has_usage"), "warning", "job_no_technologies", msg("' lists no usedTechnology or usedSkill")),
    ]
    found = F.array(
        *[F.when(cond, F.struct(*_issue(level, check, F.col("s"), m))) for cond, level, check, m in candidates]
    )
    facts = node_facts(triples) if facts is None else facts
    return facts.select(KEY, F.explode(F.array_compact(found)).alias("i")).select(KEY, "i.*")


def near_duplicate_skills(triples: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Distinct skill labels that differ in case or punctuation only."""
    facts = node_facts(triples) if facts is None else facts
    labels = facts.filter("n_skill > 0 and label is not null").select(KEY, "label", alnum_key("label").alias("k")).filter("k <> ''")
    # collect_set combines before the shuffle, so repeats of a label never travel.
    groups = labels.groupBy(KEY, "k").agg(F.array_sort(F.collect_set("label")).alias("labels")).filter("size(labels) > 1")
    message = F.concat(
        F.lit("Skill labels ['"), F.array_join("labels", "', '"), F.lit("'] look like variants of the same skill")
    )
    return groups.select(KEY, *_issue("warning", "near_duplicate_skills", F.col("k"), message))


def no_person(triples: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    facts = node_facts(triples) if facts is None else facts
    bare = facts.groupBy(KEY).agg(F.sum("n_person").alias("n")).filter("n = 0")
    return bare.select(KEY, *_issue("warning", "no_person", F.lit(""), F.lit("Graph contains no Person node")))


def graph_kind_counts(triples: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(session_id, kind, in_graph), zero included for sessions with triples."""
    facts = node_facts(triples) if facts is None else facts
    counts = facts.groupBy(KEY).agg(*[F.sum(f"n_{k}").alias(k) for k in _KINDS])
    return counts.unpivot([KEY], list(_KINDS), "kind", "in_graph")


def completeness(triples: DataFrame, extracted: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Compare the graph with what extraction produced: (session_id, kind, extracted)."""
    both = graph_kind_counts(triples, facts).join(extracted.filter("extracted > 0"), [KEY, "kind"])
    lost, low = F.col("in_graph") == 0, F.col("in_graph") < F.col("extracted") * 0.5
    gone = F.concat(
        F.lit("Extraction produced "), F.col("extracted").cast("string"), F.lit(" "), "kind",
        F.lit(" entities but the graph contains none"),
    )
    few = F.concat(
        F.lit("Graph has "), F.col("in_graph").cast("string"), F.lit(" "), "kind",
        F.lit(" entities but extraction produced "), F.col("extracted").cast("string"),
        F.lit(" (more than half lost — check deduplication)"),
    )
    return both.filter(lost | low).select(
        KEY,
        F.when(lost, "error").otherwise("warning").alias("level"),
        F.when(lost, "type_missing_in_export").otherwise("low_entity_count").alias("check"),
        F.col("kind").alias("subject"),
        F.when(lost, gone).otherwise(few).alias("message"),
    )


def all_issues(triples: DataFrame, extracted: DataFrame | None = None, facts: DataFrame | None = None) -> DataFrame:
    """Every issue of every session. ``facts``: ``node_facts`` as a table; written here when not given."""
    facts = cut_by(node_facts(triples), KEY, "s") if facts is None else facts
    parts = [
        dangling(triples, facts=facts),
        node_rules(triples, facts),
        near_duplicate_skills(triples, facts),
        no_person(triples, facts),
    ]
    if extracted is not None:
        parts.append(completeness(triples, extracted, facts))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def validation_report(triples: DataFrame, extracted: DataFrame | None = None) -> DataFrame:
    """One row per session: valid (no errors), issue counts, graph size.

    The triples are read twice: once for what is known of each node, once for the references.
    """
    facts = cut_by(node_facts(triples), KEY, "s")
    issues = all_issues(triples, extracted, facts).groupBy(KEY).agg(
        F.count_if(F.col("level") == "error").alias("errors"),
        F.count_if(F.col("level") == "warning").alias("warnings"),
    )
    sizes = facts.groupBy(KEY).agg(F.sum("n").alias("triple_count"), *[F.sum(f"n_{k}").alias(f"{k}_count") for k in _KINDS])
    zero = F.lit(0).cast("long")
    return (
        sizes.join(issues, KEY, "left")
        .withColumn("errors", F.coalesce("errors", zero))
        .withColumn("warnings", F.coalesce("warnings", zero))
        .withColumn("valid", F.col("errors") == 0)
    )


# ---------------------------------------------------------------- shapes

@dataclass(frozen=True)
class Shape:
    """One property rule of a node type."""

    rule: str
    kind: str
    path: str
    severity: str
    message: str
    min_count: int = 0
    max_count: int | None = None
    datatypes: tuple[str, ...] = ()
    iri: bool = False


_TEXT = (V.XSD_STRING,)
_DAY = (V.XSD_DATE,)
_CONF = "Recommended: confidence should appear at most once and be numeric."
_YEARS = "Recommended: yearsExperience should appear at most once and be numeric."

# Fixed rules of the lenient profile.
SHAPES = (
    Shape("person_name", "person", V.NAME, "violation", "Person should have schema:name (string).", 1, None, _TEXT),
    Shape("person_label", "person", V.PREF_LABEL, "warning", "Recommended: Person should have skos:prefLabel.", 0, 1, _TEXT),
    Shape("person_skill", "person", V.HAS_SKILL, "violation", "Person should link to skills (IRIs).", 1, None, (), True),
    Shape("person_job", "person", V.HAS_JOB, "violation", "Person should link to jobs (IRIs).", 1, None, (), True),
    Shape("person_certification", "person", V.HAS_CERT, "warning", "Recommended: certifications should be IRIs.", iri=True),
    Shape("person_alumni", "person", V.ALUMNI_OF, "warning", "Recommended: alumniOf should be IRIs.", iri=True),
    Shape("person_confidence", "person", V.CONFIDENCE, "warning", _CONF, 0, 1, V.NUMERIC_TYPES),
    Shape("job_title", "job", V.TITLE, "violation", "JobPosting should have schema:title (string).", 1, None, _TEXT),
    Shape("job_start", "job", V.START, "warning", "Recommended: schema:startDate should be xsd:date.", 0, 1, _DAY),
    Shape("job_end", "job", V.END, "warning", "Recommended: schema:endDate should be xsd:date when present.", 0, 1, _DAY),
    Shape("job_organization", "job", V.HIRING_ORG, "violation", "JobPosting should link to schema:hiringOrganization (IRI).", 1, None, (), True),
    Shape("job_technology", "job", V.USED_TECH, "warning", "Recommended: usedTechnology values should be IRIs.", iri=True),
    Shape("job_confidence", "job", V.CONFIDENCE, "warning", _CONF, 0, 1, V.NUMERIC_TYPES),
    Shape("skill_label", "skill", V.PREF_LABEL, "violation", "Skill should have skos:prefLabel (string).", 1, None, _TEXT),
    Shape("skill_category", "skill", V.CATEGORY, "warning", "If present, skillCategory should be a string.", 0, 1, _TEXT),
    Shape("skill_proficiency", "skill", V.PROFICIENCY, "warning", "If present, proficiencyLevel should be a string.", 0, 1, _TEXT),
    Shape("skill_years", "skill", V.YEARS, "warning", _YEARS, 0, 1, V.NUMERIC_TYPES),
    Shape("skill_confidence", "skill", V.CONFIDENCE, "warning", _CONF, 0, 1, V.NUMERIC_TYPES),
)


def check_shapes(triples: DataFrame, shapes: tuple[Shape, ...] = SHAPES) -> DataFrame:
    """Evaluate property rules in one aggregation per node.

    A row per broken constraint: min_count, max_count, datatype or node_kind,
    with the number of values that break it.
    """
    p, o, kind = F.col("p"), F.col("o"), F.col("o_kind")
    aggs = [
        F.max((p == V.RDF_TYPE) & (o == V.TYPE_IRI[k])).alias(f"is_{k}") for k in sorted({s.kind for s in shapes})
    ]
    for path_i, path in enumerate(sorted({s.path for s in shapes})):
        aggs.append(F.count_if(p == path).alias(f"n_{path_i}"))
    index = {path: i for i, path in enumerate(sorted({s.path for s in shapes}))}
    rows = []
    for i, s in enumerate(shapes):
        n = F.col(f"n_{index[s.path]}")
        applies = F.col(f"is_{s.kind}")
        checks = []
        if s.min_count:
            checks.append(("min_count", n < s.min_count, n))
        if s.max_count is not None:
            checks.append(("max_count", n > s.max_count, n))
        if s.datatypes:
            aggs.append(
                F.count_if((p == s.path) & ~((kind == "literal") & F.coalesce(F.col("o_type").isin(*s.datatypes), F.lit(False)))).alias(f"dt_{i}")
            )
            checks.append(("datatype", F.col(f"dt_{i}") > 0, F.col(f"dt_{i}")))
        if s.iri:
            aggs.append(F.count_if((p == s.path) & (kind != "iri")).alias(f"nk_{i}"))
            checks.append(("node_kind", F.col(f"nk_{i}") > 0, F.col(f"nk_{i}")))
        for name, broken, count in checks:
            rows.append(
                F.when(
                    applies & broken,
                    F.struct(
                        F.lit(s.rule).alias("rule"),
                        F.lit(name).alias("constraint"),
                        F.lit(s.severity).alias("severity"),
                        count.cast("long").alias("n_values"),
                        F.lit(s.message).alias("message"),
                    ),
                )
            )
    profile = triples.groupBy(KEY, "s").agg(*aggs)
    return profile.select(KEY, F.col("s").alias("subject"), F.explode(F.array_compact(F.array(*rows))).alias("v")).select(
        KEY, "subject", "v.*"
    )


def unlabelled_targets(triples: DataFrame, predicates: tuple[str, ...], rule: str, message: str) -> DataFrame:
    """Objects of ``predicates`` without a name, preferred label or rdfs label."""
    targets = triples.filter(F.col("p").isin(*predicates)).select(KEY, F.col("o").alias("subject")).distinct()
    labelled = triples.filter(
        F.col("p").isin(V.NAME, V.PREF_LABEL, V.RDFS_LABEL) & (F.col("o_type") == V.XSD_STRING)
    ).select(KEY, F.col("s").alias("subject"))
    return targets.join(labelled, [KEY, "subject"], "left_anti").select(
        KEY, "subject", F.lit(rule).alias("rule"), F.lit("warning").alias("severity"), F.lit(message).alias("message")
    )


def unlabelled_organizations(triples: DataFrame) -> DataFrame:
    return unlabelled_targets(
        triples, (V.HIRING_ORG, V.ALUMNI_OF), "organization_label",
        "Recommended: Org/Institution nodes should have a human-readable label.",
    )


def unlabelled_certifications(triples: DataFrame) -> DataFrame:
    return unlabelled_targets(
        triples, (V.HAS_CERT,), "certification_label",
        "Recommended: Certification nodes should have a human-readable label.",
    )
