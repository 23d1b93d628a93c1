"""Raw extraction records -> entity tables.

Input is one row per document: session_id, doc_id, source_doc and the nested
columns of ``schemas.ENTITY_RECORD``. Ids are derived from the document and the
position of the record, so a rerun gives the same ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careerloom.functions import case_key, degree_label, first_nonempty, org_slug, parse_partial_date, strip
from careerloom.operators.common import KEY, resolve_chains

DOC = [KEY, "doc_id"]


def _items(raw: DataFrame, column: str) -> DataFrame:
    return raw.select(*DOC, "source_doc", F.posexplode(column).alias("pos", "r"))


def _id(kind: str, pos: str = "pos") -> Column:
    return F.concat_ws(":", "doc_id", F.lit(kind), F.col(pos).cast("string"))


def _conf() -> Column:
    return F.coalesce("r.confidence", F.lit(1.0)).alias("confidence")


def org_mentions(raw: DataFrame) -> DataFrame:
    """Every mention of an organization in a document, in reading order."""

    def rows(column: str, src: int, name: Column, candidate: Column, org_type: Column, full: bool) -> DataFrame:
        none = F.lit(None).cast("string")
        extra = ("location", "website", "description")
        return _items(raw, column).select(
            *DOC, "source_doc", F.lit(src).alias("src"), "pos",
            strip(name).alias("name"), candidate.alias("candidate"), org_type.alias("org_type"),
            *[(F.col(f"r.{c}") if full else none).alias(c) for c in extra], _conf(),
        )

    company = first_nonempty("r.company", "r.organization", "r.organization_name")
    has = lambda df: df.filter("coalesce(nullif(name, ''), nullif(candidate, '')) is not null")
    orgs = rows("organizations", 0, F.coalesce("r.name", "r.label", F.lit("")), F.nullif("r.id", F.lit("")), F.col("r.org_type"), True)
    jobs = rows(
        "jobs", 1, F.coalesce(company, "r.organization_id"), F.nullif("r.organization_id", F.lit("")),
        F.coalesce(F.nullif("r.org_type", F.lit("")), F.lit("Company")), False,
    )
    edus = rows(
        "education", 2, F.coalesce(F.nullif("r.institution", F.lit("")), "r.institution_id"), F.nullif("r.institution_id", F.lit("")),
        F.coalesce(F.nullif("r.org_type", F.lit("")), F.lit("University")), False,
    )
    return orgs.unionByName(has(jobs)).unionByName(has(edus))


def register_orgs(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One organization per name or id alias within a document.

    Returns (organizations, mention -> org_id). A mention belongs to its name;
    a name first seen together with a known id belongs to that id's owner.
    """
    m = org_mentions(raw).withColumn("ord", F.struct("src", "pos")).withColumn(
        "name_key", F.nullif(case_key("name"), F.lit(""))
    )
    named = m.filter("candidate is not null and name_key is not null")
    by_id = named.groupBy(*DOC, "candidate").agg(F.min_by("name_key", "ord").alias("id_name"))
    m = m.join(by_id, [*DOC, "candidate"], "left").withColumn(
        "key",
        F.coalesce(
            "name_key", "id_name", F.concat(F.lit("\0id:"), "candidate"),
            F.concat_ws(":", F.lit("\0anon"), F.col("src").cast("string"), F.col("pos").cast("string")),
        ),
    )
    owner = m.filter("candidate is not null").groupBy(*DOC, "candidate").agg(F.min_by("key", "ord").alias("owner"))
    heads = m.groupBy(*DOC, "key").agg(F.min("ord").alias("head"), F.min_by("candidate", "ord").alias("candidate"))
    links = (
        heads.join(owner, [*DOC, "candidate"])
        .filter("owner <> key")
        .select(*DOC, F.col("key").alias("src"), F.col("owner").alias("dst"))
    )
    roots = resolve_chains(links, DOC).select(*DOC, F.col("src").alias("key"), F.col("dst").alias("root"))
    m = (
        m.join(heads.select(*DOC, "key", "head"), [*DOC, "key"])
        .join(roots, [*DOC, "key"], "left")
        .withColumn("root", F.coalesce("root", "key"))
    )
    # Only a mention without a name, or the first one of its name, fills fields.
    fills = m.filter("name_key is null or ord = head")
    first = lambda c: F.min_by(c, F.when(F.col(c) != "", F.col("ord"))).alias(c)
    orgs = fills.groupBy(*DOC, "source_doc", "root").agg(
        F.min("ord").alias("ord"),
        F.min_by("candidate", "ord").alias("candidate"),
        F.min_by("confidence", "ord").alias("confidence"),
        *[first(c) for c in ("name", "org_type", "location", "website", "description")],
    )
    slug = F.coalesce(org_slug("candidate", F.coalesce("name", "candidate")), F.concat(F.lit("org-"), F.md5(F.concat("doc_id", "root"))))
    nth = F.row_number().over(Window.partitionBy(*DOC, "slug").orderBy("ord"))
    orgs = (
        orgs.withColumn("slug", slug)
        .withColumn("nth", nth)
        .withColumn("org_id", F.when(F.col("nth") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", F.col("nth").cast("string"))))
    )
    out = orgs.select(
        *DOC, "source_doc", "org_id", F.coalesce("name", "org_id").alias("name"),
        "org_type", "location", "website", "description", "confidence",
        F.row_number().over(Window.partitionBy(*DOC).orderBy("ord")).alias("pos"),
    )
    mention_map = m.select(*DOC, "src", "pos", "root").join(orgs.select(*DOC, "root", "org_id"), [*DOC, "root"])
    return out, mention_map.select(*DOC, "src", "pos", "org_id")


def build_skills(raw: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    return _items(raw, "skills").select(
        *DOC, "source_doc", "pos", _id("skill").alias("skill_id"),
        F.coalesce("r.label", "r.name", F.lit("")).alias("label"),
        "r.category", "r.proficiency_level", "r.years_experience", "r.skos_uri",
        *[F.coalesce(f"r.{c}", empty).alias(c) for c in ("broader_concepts", "narrower_concepts", "related_concepts", "alt_labels")],
        _conf(),
    )


def job_skill_names(raw: DataFrame) -> DataFrame:
    """(doc, job_id, kind, pos, name): skills and technologies named in jobs."""
    jobs = _items(raw, "jobs").withColumn("job_id", _id("job"))
    part = lambda c, kind: jobs.select(
        *DOC, "source_doc", "job_id", F.lit(kind).alias("kind"), F.posexplode(f"r.{c}").alias("pos", "name")
    )
    return part("skills_used", "skill").unionByName(part("technologies_used", "technology")).filter("name <> ''")


def resolve_skill_names(names: DataFrame, skills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names in jobs -> skill ids by exact label within the document.

    Returns (job_skill bridge, skills created for names nobody declared).
    """
    # A label declared twice in a document means its last declaration.
    known = skills.groupBy(*DOC, F.col("label").alias("name")).agg(F.max_by("skill_id", "pos").alias("skill_id"))
    made_id = F.concat_ws(":", "doc_id", F.lit("skill"), F.md5("name"))
    bridge = names.join(known, [*DOC, "name"], "left").select(
        *DOC, "job_id", "kind", "pos", F.coalesce("skill_id", made_id).alias("skill_id")
    )
    empty = F.array().cast("array<string>")
    created = (
        names.join(known, [*DOC, "name"], "left_anti")
        .select(*DOC, "source_doc", "name")
        .distinct()
        .select(
            *DOC, "source_doc", F.lit(1 << 30).alias("pos"), made_id.alias("skill_id"), F.col("name").alias("label"),
            F.lit("Technical").alias("category"), F.lit(None).cast("string").alias("proficiency_level"),
            F.lit(None).cast("double").alias("years_experience"), F.lit(None).cast("string").alias("skos_uri"),
            *[empty.alias(c) for c in ("broader_concepts", "narrower_concepts", "related_concepts", "alt_labels")],
            F.lit(1.0).alias("confidence"),
        )
    )
    return bridge, created


def _with_org(items: DataFrame, mention_map: DataFrame, src: int) -> DataFrame:
    m = mention_map.filter(F.col("src") == src).select(*DOC, "pos", "org_id")
    return items.join(m, [*DOC, "pos"], "left")


def build_jobs(raw: DataFrame, mention_map: DataFrame) -> DataFrame:
    return _with_org(_items(raw, "jobs"), mention_map, 1).select(
        *DOC, "source_doc", "pos", _id("job").alias("job_id"),
        F.coalesce("r.title", F.lit("")).alias("title"),
        F.coalesce("org_id", F.lit("")).alias("org_id"),
        parse_partial_date("r.start_date").alias("start_date"),
        parse_partial_date("r.end_date").alias("end_date"),
        F.coalesce("r.is_current", F.lit(False)).alias("is_current"),
        "r.location", "r.description",
        F.coalesce("r.achievements", F.array().cast("array<string>")).alias("achievements"),
        _conf(),
    )


def build_education(raw: DataFrame, mention_map: DataFrame, orgs: DataFrame) -> DataFrame:
    names = orgs.select(*DOC, "org_id", F.col("name").alias("org_name"))
    return (
        _with_org(_items(raw, "education"), mention_map, 2)
        .join(names, [*DOC, "org_id"], "left")
        .select(
            *DOC, "source_doc", "pos", _id("education").alias("edu_id"),
            degree_label("r.degree_type", "r.field_of_study", "org_name").alias("label"),
            F.coalesce("r.degree_type", F.lit("")).alias("degree_type"),
            "r.field_of_study",
            F.coalesce("org_id", F.lit("")).alias("institution_id"),
            parse_partial_date("r.start_date").alias("start_date"),
            parse_partial_date("r.end_date").alias("end_date"),
            F.coalesce("r.is_current", F.lit(False)).alias("is_current"),
            "r.location", "r.description", "r.gpa", _conf(),
        )
    )


def build_certifications(raw: DataFrame) -> DataFrame:
    return _items(raw, "certifications").select(
        *DOC, "source_doc", "pos", _id("certification").alias("cert_id"),
        F.coalesce("r.name", F.lit("")).alias("name"),
        "r.issuing_organization",
        parse_partial_date("r.issue_date").alias("issue_date"),
        parse_partial_date("r.expiration_date").alias("expiration_date"),
        "r.credential_id", "r.credential_url",
        F.coalesce("r.is_active", F.lit(True)).alias("is_active"),
        _conf(),
    )


def build_person(raw: DataFrame) -> DataFrame:
    return raw.select(
        *DOC, "source_doc", F.concat_ws(":", "doc_id", F.lit("person")).alias("person_id"),
        F.coalesce("person.name", F.lit("")).alias("name"),
        "person.email", "person.phone", "person.location", "person.summary",
        F.coalesce("person.confidence", F.lit(1.0)).alias("confidence"),
    )


def person_references(
    persons: DataFrame, jobs: DataFrame, skills: DataFrame, education: DataFrame, certifications: DataFrame
) -> DataFrame:
    """Bridge (session_id, doc_id, person_id, kind, id) of everything in a person's document."""
    part = lambda df, kind, c: df.select(*DOC, F.lit(kind).alias("kind"), F.col(c).alias("id"))
    refs = (
        part(jobs, "job", "job_id")
        .unionByName(part(skills, "skill", "skill_id"))
        .unionByName(part(education, "education", "edu_id"))
        .unionByName(part(certifications, "certification", "cert_id"))
    )
    return refs.join(persons.select(*DOC, "person_id"), DOC)


def empty_extraction_flag() -> Column:
    """True for a record that parsed but holds no entity."""
    lists = ("jobs", "skills", "education", "certifications", "organizations")
    return F.col("person").isNull() & F.greatest(
        F.lit(0), *[F.coalesce(F.array_size(c), F.lit(0)) for c in lists]
    ).eqNullSafe(0)


def entity_counts(kinds: DataFrame, keys: tuple[str, ...] = (KEY, "doc_id")) -> DataFrame:
    """Counts per entity kind and in total; ``kinds`` has one row per entity."""
    names = ("person", "job", "skill", "education", "certification", "organization")
    return kinds.groupBy(*keys).agg(
        *[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in names], F.count("*").alias("total")
    )


def assemble(raw: DataFrame) -> dict[str, DataFrame]:
    """All entity tables of a batch of extraction records."""
    orgs, mentions = register_orgs(raw)
    declared = build_skills(raw)
    bridge, created = resolve_skill_names(job_skill_names(raw), declared)
    skills = declared.unionByName(created)
    jobs, education = build_jobs(raw, mentions), build_education(raw, mentions, orgs)
    certs, persons = build_certifications(raw), build_person(raw)
    return {
        "organizations": orgs,
        "skills": skills,
        "jobs": jobs,
        "job_skill": bridge,
        "education": education,
        "certifications": certs,
        "persons": persons,
        "person_refs": person_references(persons, jobs, skills, education, certs),
    }
