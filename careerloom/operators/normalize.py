"""Label reconciliation across the documents of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerloom import vocab as V
from careerloom.functions import case_key, iri_local_name, mint_iri, strip, url_decode_label
from careerloom.operators.common import KEY, first_by, resolve_chains
from careerloom.runtime import cut

POOL = [KEY, "pool"]


def label_pools(
    skills: DataFrame, job_tech: DataFrame, orgs: DataFrame | None = None, education: DataFrame | None = None
) -> DataFrame:
    """Distinct decoded labels per session and pool, with flags and taxonomy URI.

    Skills and technologies share the pool ``skill``; organizations and degrees
    have their own, so equal texts of different kinds never meet.
    """

    def rows(df: DataFrame, pool: str, label: str, declared: bool, verified: Column, uri: Column) -> DataFrame:
        return df.select(
            KEY,
            F.lit(pool).alias("pool"),
            url_decode_label(label).alias("label"),
            F.lit(declared).alias("declared"),
            verified.alias("verified"),
            uri.alias("uri"),
        )

    no, none = F.lit(False), F.lit(None).cast("string")
    parts = [
        rows(skills, "skill", "label", True, F.coalesce("user_verified", no), F.col("skos_uri")),
        rows(job_tech, "skill", "label", False, no, none),
    ]
    if orgs is not None:
        parts.append(rows(orgs, "org", "name", False, no, none))
    if education is not None:
        parts.append(rows(education, "degree", "degree_type", False, no, none))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return (
        out.filter(strip("label") != "")
        .groupBy(*POOL, "label")
        .agg(F.max("declared").alias("declared"), F.max("verified").alias("verified"), F.min("uri").alias("uri"))
    )


def phase1_case(labels: DataFrame, prefer_declared: bool = False) -> DataFrame:
    """Merge labels that differ in case only.

    Canonical: capitalised first, then longest, then smallest; with
    ``prefer_declared`` a declared skill goes before all of these.
    """
    head = F.substring("label", 1, 1)
    capital = (F.upper(head) == head) & (F.lower(head) != head)
    order = [~capital, -F.length("label"), F.col("label")]
    if prefer_declared:
        order = [~F.col("declared"), *order]
    keyed = labels.withColumn("k", case_key("label"))
    canon = first_by(keyed, [*POOL, "k"], F.col("label"), order, "canonical")
    return keyed.join(canon, [*POOL, "k"]).filter("label <> canonical").select(*POOL, "label", "canonical")


def phase2_uri(labels: DataFrame, phase1: DataFrame) -> DataFrame:
    """Merge the labels left after phase 1 that carry the same taxonomy URI."""
    left = (
        labels.filter((F.col("pool") == "skill") & F.col("uri").isNotNull())
        .join(phase1, [*POOL, "label"], "left_anti")
        .select(*POOL, "uri", "label")
    )
    canon = left.groupBy(*POOL, "uri").agg(F.min("label").alias("canonical"))
    return left.join(canon, [*POOL, "uri"]).filter("label <> canonical").select(*POOL, "label", "canonical")


def phase3_alias(groups: DataFrame) -> DataFrame:
    """Alias groups (canonical, members) from any source as label merges."""
    return (
        groups.filter(F.size("members") > 1)
        .select(*POOL, "canonical", F.explode("members").alias("label"))
        .filter("label <> canonical")
        .groupBy(*POOL, "label")
        .agg(F.min("canonical").alias("canonical"))
    )


def phase_gate(groups: DataFrame, documents: DataFrame, single_document: bool = False) -> DataFrame:
    """Alias groups of sessions with two or more completed documents (or all)."""
    if single_document:
        return groups
    ready = (
        documents.filter("status = 'complete'").groupBy(KEY).agg(F.count("*").alias("n")).filter("n >= 2").select(KEY)
    )
    return groups.join(ready, KEY, "left_semi")


def chain_maps(labels: DataFrame, phase1: DataFrame, phase2: DataFrame, phase3: DataFrame) -> DataFrame:
    """label -> canonical through all phases; alias chains are followed to their end.

    Verified labels are anchors: others may map to them, they keep their name.
    """
    closed = resolve_chains(
        phase3.select(*POOL, F.col("label").alias("src"), F.col("canonical").alias("dst")), POOL
    )
    step = lambda m, old, new: m.select(*POOL, F.col("label").alias(old), F.col("canonical").alias(new))
    out = (
        labels.select(*POOL, "label", "verified")
        .join(step(phase1, "label", "n1"), [*POOL, "label"], "left")
        .withColumn("c1", F.coalesce("n1", "label"))
        .join(step(phase2, "c1", "n2"), [*POOL, "c1"], "left")
        .withColumn("c2", F.coalesce("n2", "c1"))
        .join(closed.select(*POOL, F.col("src").alias("c2"), F.col("dst").alias("n3")), [*POOL, "c2"], "left")
        .withColumn("c3", F.coalesce("n3", "c2"))
    )
    phase = (
        F.when(F.col("verified"), "verified")
        .when(F.col("c3") != F.col("c2"), "alias")
        .when(F.col("c2") != F.col("c1"), "uri")
        .when(F.col("c1") != F.col("label"), "case")
        .otherwise("none")
    )
    return anchor_verified(out.select(*POOL, "label", "verified", F.col("c3").alias("canonical"), phase.alias("phase")))


def anchor_verified(label_map: DataFrame) -> DataFrame:
    return label_map.withColumn("canonical", F.when(F.col("verified"), F.col("label")).otherwise(F.col("canonical")))


def build_label_map(labels: DataFrame, alias_groups: DataFrame, prefer_declared: bool = False) -> DataFrame:
    p1 = cut(phase1_case(labels, prefer_declared))
    return chain_maps(labels, p1, phase2_uri(labels, p1), phase3_alias(alias_groups))


def _pool_map(label_map: DataFrame, pool: str) -> DataFrame:
    return label_map.filter(F.col("pool") == pool).select(KEY, F.col("label").alias("_old"), "canonical")


def apply_to_skills(skills: DataFrame, label_map: DataFrame) -> DataFrame:
    """Rename skills; the old label stays as an alternative. Verified rows keep theirs."""
    df = skills.withColumn("_old", url_decode_label("label")).join(
        _pool_map(label_map, "skill"), [KEY, "_old"], "left"
    )
    new = F.coalesce("canonical", "_old")
    keep = F.coalesce("user_verified", F.lit(False))
    alts = F.coalesce("alt_labels", F.array().cast("array<string>"))
    grown = F.when((new != F.col("_old")) & ~F.array_contains(alts, F.col("_old")), F.array_append(alts, F.col("_old")))
    return df.select(
        *[
            F.when(keep, F.col("label")).otherwise(new).alias("label")
            if c == "label"
            else F.when(keep, alts).otherwise(F.coalesce(grown, alts)).alias("alt_labels")
            if c == "alt_labels"
            else F.col(c)
            for c in skills.columns
        ]
    )


def apply_to_job_tech(job_tech: DataFrame, label_map: DataFrame) -> DataFrame:
    """Map each technology of a job; repeats keep their first position."""
    return (
        job_tech.withColumn("_old", url_decode_label("label"))
        .join(_pool_map(label_map, "skill"), [KEY, "_old"], "left")
        .groupBy(KEY, "job_id", F.coalesce("canonical", "_old").alias("label"))
        .agg(F.min("pos").alias("pos"))
    )


def _rename(df: DataFrame, label_map: DataFrame, pool: str, column: str) -> DataFrame:
    old = url_decode_label(column)
    out = df.withColumn("_old", old).join(_pool_map(label_map, pool), [KEY, "_old"], "left")
    return out.withColumn(column, F.coalesce("canonical", "_old")).drop("_old", "canonical")


def apply_to_orgs(orgs: DataFrame, label_map: DataFrame) -> DataFrame:
    return _rename(orgs, label_map, "org", "name")


def apply_to_education(education: DataFrame, label_map: DataFrame) -> DataFrame:
    return _rename(education, label_map, "degree", "degree_type")


def normalization_report(label_map: DataFrame) -> DataFrame:
    """Labels before and after, merges per phase, and the reduction in percent."""
    changed = F.col("label") != F.col("canonical")
    return (
        label_map.groupBy(KEY, "pool", "canonical")
        .agg(
            F.count("*").alias("n"),
            F.count_if(changed).alias("m"),
            *[F.count_if(changed & (F.col("phase") == p)).alias(p) for p in ("case", "uri", "alias")],
        )
        .groupBy(KEY)
        .agg(
            F.sum("n").alias("original_labels"),
            F.count("*").alias("final_unique_labels"),
            F.sum("m").alias("total_merges"),
            F.sum("case").alias("case_merges"),
            F.sum("uri").alias("uri_merges"),
            F.sum("alias").alias("alias_merges"),
        )
        .withColumn(
            "reduction_pct",
            F.bround((1 - F.col("final_unique_labels") / F.col("original_labels")) * 100, 1),
        )
    )


def tech_index(job_tech: DataFrame) -> DataFrame:
    """Technology -> jobs using it, one row per pair, with the technology's job count."""
    pairs = job_tech.select(KEY, url_decode_label("label").alias("label"), "job_id").distinct()
    counts = pairs.groupBy(KEY, "label").agg(F.count("*").alias("n_jobs"))
    return pairs.join(counts, [KEY, "label"])


def rewrite_triples(triples: DataFrame, label_map: DataFrame) -> DataFrame:
    """Apply a label map to a graph.

    Skill labels become canonical and gain all variants as alternatives; used
    technologies are renamed and collapse. Ids and taxonomy links stay.
    """
    cols = triples.columns
    m = _pool_map(label_map, "skill").filter("_old <> canonical")
    skills = triples.filter((F.col("p") == V.RDF_TYPE) & (F.col("o") == V.TYPE_IRI["skill"])).select(KEY, "s")
    is_label = (F.col("p") == V.PREF_LABEL) & (F.col("o_kind") == "literal")
    is_tech = F.col("p") == V.USED_TECH

    labels = triples.filter(is_label).join(skills, [KEY, "s"], "left_semi")
    renamed = (
        labels.join(m.withColumnRenamed("_old", "o"), [KEY, "o"], "left")
        .withColumn("o", F.coalesce("canonical", "o"))
    )
    variants = m.withColumnRenamed("_old", "variant")
    alts = (
        renamed.filter("canonical is not null")
        .select(KEY, "s", "canonical", "o_kind", "o_type")
        .join(variants, [KEY, "canonical"])
        .select(KEY, "s", F.lit(V.ALT_LABEL).alias("p"), F.col("variant").alias("o"), "o_kind", "o_type")
    )
    tech = triples.filter(is_tech)
    iri = F.col("o_kind") == "iri"
    tech = tech.withColumn("_old", F.when(iri, iri_local_name("o")).otherwise(url_decode_label("o")))
    tech = tech.join(m, [KEY, "_old"], "left").withColumn(
        "o", F.when(iri, F.coalesce(mint_iri("canonical"), "o")).otherwise(F.coalesce("canonical", "_old"))
    )
    others = triples.filter(~is_label & ~is_tech).unionByName(
        triples.filter(is_label).join(skills, [KEY, "s"], "left_anti")
    )
    return (
        others.select(*cols)
        .unionByName(renamed.select(*cols))
        .unionByName(alts.select(*cols))
        .unionByName(tech.select(*cols).distinct())
        .distinct()
    )
