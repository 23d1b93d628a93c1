"""Entity tables -> deduplicated graph as a triples DataFrame."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerloom import vocab as V
from careerloom.functions import case_key, dates_within_days, is_expired, mint_iri, org_dedup_key, title_similarity
from careerloom.operators.common import KEY, canonical_map, keep
from careerloom.runtime import cut, cut_by, discard

ORDER = ("doc_id", "pos")


def _stored(df: DataFrame, buckets: int | None) -> DataFrame:
    return cut(df) if buckets is None else keep(df, buckets)


# ---------------------------------------------------------------- identity

def _blank(c: str) -> Column:
    return F.coalesce(case_key(c), F.lit(""))


def _or_own(key: Column, id_col: str) -> Column:
    """A blank key identifies nothing, so the entity keeps to itself."""
    return F.coalesce(F.nullif(key, F.lit("")), F.concat(F.lit("\0"), F.col(id_col)))


def _skill_key(skills: DataFrame) -> DataFrame:
    return skills.withColumn("k1", _or_own(case_key("label"), "skill_id"))


def _org_key(orgs: DataFrame) -> DataFrame:
    return orgs.withColumn("k1", _or_own(org_dedup_key("name"), "org_id"))


def _edu_key(education: DataFrame, org_map: DataFrame) -> DataFrame:
    return canonical_refs(education, "institution_id", org_map, "_inst").select(
        *education.columns,
        F.concat_ws("\0", _blank("degree_type"), _blank("field_of_study"), F.coalesce("_inst", F.lit(""))).alias("k1"),
    )


def _cert_key(certs: DataFrame) -> DataFrame:
    return certs.withColumn("k1", F.concat_ws("\0", _or_own(case_key("name"), "cert_id"), _blank("issuing_organization")))


def first_rows(keyed: DataFrame, id_col: str) -> DataFrame:
    """The surviving row of every key: the first by document, position and id."""
    row = F.struct(*[c for c in keyed.columns if c not in (KEY, "k1")])
    return (
        keyed.groupBy(KEY, "k1")
        .agg(F.min_by(row, F.struct(*ORDER, id_col)).alias("r"))
        .select(KEY, "k1", "r.*")
    )


def id_map(keyed: DataFrame, firsts: DataFrame, id_col: str) -> DataFrame:
    """(session_id, id, canonical_id): every id mapped to its key's survivor."""
    heads = firsts.select(KEY, "k1", F.col(id_col).alias("canonical_id"))
    return (
        keyed.select(KEY, "k1", F.col(id_col).alias("id"))
        .join(heads, [KEY, "k1"])
        .groupBy(KEY, "id")
        .agg(F.min("canonical_id").alias("canonical_id"))
    )


def dedup_skills(skills: DataFrame) -> DataFrame:
    """Skills with the same case key are one node; an unlabelled skill stays alone."""
    return canonical_map(_skill_key(skills), ["k1"], "skill_id", [*ORDER, "skill_id"])


def dedup_orgs(orgs: DataFrame) -> DataFrame:
    return canonical_map(_org_key(orgs), ["k1"], "org_id", [*ORDER, "org_id"])


def canonical_refs(df: DataFrame, ref: str, id_map: DataFrame, out: str | None = None) -> DataFrame:
    """Replace references by their canonical id; unknown ones stay, so that the
    validator sees them."""
    m = id_map.select(KEY, F.col("id").alias(ref), F.col("canonical_id").alias("_canon"))
    joined = df.join(m, [KEY, ref], "left")
    return joined.withColumn(out or ref, F.coalesce("_canon", ref)).drop("_canon").select(
        *df.columns, *([out] if out and out not in df.columns else [])
    )


def _keyed_jobs(jobs: DataFrame, org_map: DataFrame) -> DataFrame:
    return canonical_refs(jobs, "org_id", org_map, "_org").select(
        KEY,
        "job_id",
        _blank("title").alias("title_key"),
        F.coalesce("_org", F.lit("")).alias("org_key"),
        "start_date",
        F.coalesce(F.col("start_date").cast("string"), F.lit("")).alias("start_key"),
    )


_JOB_KEYS = ["title_key", "org_key", "start_key"]


def _job_heads(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy(KEY, *_JOB_KEYS).agg(F.min("job_id").alias("job_id"), F.min("start_date").alias("start_date"))


def _exact_map(keyed: DataFrame, heads: DataFrame) -> DataFrame:
    return (
        keyed.select(KEY, *_JOB_KEYS, F.col("job_id").alias("id"))
        .join(heads.select(KEY, *_JOB_KEYS, F.col("job_id").alias("canonical_id")), [KEY, *_JOB_KEYS])
        .groupBy(KEY, "id")
        .agg(F.min("canonical_id").alias("canonical_id"))
    )


def dedup_jobs_exact(jobs: DataFrame, org_map: DataFrame) -> DataFrame:
    """Same title, canonical organization and start date."""
    keyed = _keyed_jobs(jobs, org_map)
    return _exact_map(keyed, _job_heads(keyed))


def similar_titles(
    titles: DataFrame, similarity: Callable[[Column, Column], Column] = title_similarity, threshold: float = 0.85
) -> DataFrame:
    """Pairs (title_new, title_old) within a session and organization.

    Candidates share a text segment instead of a group: at most
    ``d = (1-t)/t * 2 * len`` insertions and deletions can separate two titles
    of ratio >= t, so cutting the shorter one into d+1 pieces leaves at least
    one piece whole in the longer one. No pair is missed and groups are never
    paired in full.
    """
    growth = (1 - threshold) / threshold * 2
    widest = (2 - threshold) / threshold
    # An organization with one title has no pair.
    crowded = titles.groupBy(KEY, "org_key").agg(F.count("*").alias("c")).filter("c > 1").select(KEY, "org_key")
    t = (
        titles.filter("title_key <> ''")
        .join(crowded, [KEY, "org_key"], "left_semi")
        .withColumn("n", F.length("title_key"))
    )
    pieces = F.floor(F.col("n") * F.lit(growth)).cast("int") + 1
    piece = lambda i, k: F.substr(
        F.col("title_key"),
        F.floor(i * F.col("n") / k).cast("int") + 1,
        (F.floor((i + 1) * F.col("n") / k) - F.floor(i * F.col("n") / k)).cast("int"),
    )
    shorter = (
        t.withColumn("k", F.least(pieces, F.col("n")))
        .select(
            KEY, "org_key", F.col("title_key").alias("a"), F.col("n").alias("na"),
            F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: piece(i, F.col("k"))))).alias("gram"),
        )
    )
    # A title of na characters is cut into more than growth * na pieces, so none
    # is longer than 1/growth; the shortest partner gives the shortest piece.
    longest = math.ceil(1 / growth)
    na_min = F.ceil(F.col("n") / F.lit(widest))
    least = F.greatest(F.lit(1), F.floor(na_min / (na_min * F.lit(growth) + 1))).cast("int")
    grams = F.flatten(
        F.transform(
            F.sequence(F.least(least, F.col("n")), F.least(F.lit(longest), F.col("n"))),
            lambda w: F.transform(
                F.sequence(F.lit(1), F.col("n") - w + 1), lambda i: F.substr(F.col("title_key"), i, w)
            ),
        )
    )
    longer = t.select(
        KEY, "org_key", F.col("title_key").alias("b"), F.col("n").alias("nb"), F.explode(F.array_distinct(grams)).alias("gram")
    )
    cand = (
        shorter.join(longer, [KEY, "org_key", "gram"])
        .filter((F.col("na") <= F.col("nb")) & (F.col("nb") <= F.col("na") * F.lit(widest)) & (F.col("a") != F.col("b")))
        .select(KEY, "org_key", "a", "b")
        .distinct()
    )
    both = cand.select(
        KEY,
        "org_key",
        F.explode(
            F.array(
                F.struct(F.col("a").alias("title_new"), F.col("b").alias("title_old")),
                F.struct(F.col("b").alias("title_new"), F.col("a").alias("title_old")),
            )
        ).alias("q"),
    ).select(KEY, "org_key", "q.title_new", "q.title_old").distinct()
    matched = both.filter(similarity(F.col("title_new"), F.col("title_old")) >= threshold)
    same = titles.select(KEY, "org_key", F.col("title_key").alias("title_new"), F.col("title_key").alias("title_old"))
    return matched.unionByName(same)


def absorbed_jobs(pairs: DataFrame, days: int) -> DataFrame:
    """(session, job_id, leader): jobs that an earlier leader absorbs, by one sweep along the dates of an organization.

    ``pairs``: session, org_key, a, b with a before b as ``(start_key, job_id)`` structs, similar and close in time. In
    the order of b every a is decided before b is, so whether it leads is known. Only the absorbed jobs of the last
    ``days`` are remembered, however long a chain is.
    """
    flat = pairs.select(KEY, "org_key", *[F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in "ba" for c in ("start_key", "job_id")])
    order = ["b_start_key", "b_job_id", "a_start_key", "a_job_id"]
    rows = flat.repartition(KEY, "org_key").sortWithinPartitions(KEY, "org_key", *order)
    key_type = pairs.schema[KEY].dataType.simpleString()

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = now = None
        absorbed: dict[str, str] = {}  # job -> its start
        for batch in batches:
            out = []
            for key, org, start, job, a_start, a_job in zip(*(batch.column(c).to_pylist() for c in (KEY, "org_key", *order))):
                if (key, org) != group:
                    group, now, absorbed = (key, org), None, {}
                if start != now:
                    now = start
                    if start:
                        oldest = str(date.fromisoformat(start) - timedelta(days=days))
                        absorbed = {j: d for j, d in absorbed.items() if not d or d >= oldest}
                # The first leader takes the job; its other pairs come right behind.
                if job not in absorbed and a_job not in absorbed:
                    absorbed[job] = start
                    out.append((key, job, a_job))
            columns = zip(*out) if out else ([], [], [])
            kinds = [batch.schema.field(KEY).type, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[KEY, "job_id", "leader"])

    return rows.mapInArrow(sweep, f"{KEY} {key_type}, job_id string, leader string")


def dedup_jobs(
    jobs: DataFrame,
    org_map: DataFrame,
    fuzzy: bool = True,
    similarity: Callable[[Column, Column], Column] = title_similarity,
    threshold: float = 0.85,
    days: int = 30,
    buckets: int | None = None,
    made: list[DataFrame] | None = None,
) -> DataFrame:
    """Exact duplicates first, then near ones.

    Jobs of one organization are taken by (start date, id). A job is absorbed by
    the earliest leader with a similar title within ``days``; an absorbed job
    leads nobody. After the exact pass a job has at most one partner per date
    and title, so the pair table is bounded by dates, not by group size. Chains
    of jobs are resolved in one sweep, however long they are. The tables that the
    result reads are added to ``made``.
    """
    keyed = _stored(_keyed_jobs(jobs, org_map), buckets)
    alive = _stored(_job_heads(keyed), buckets)
    if made is not None:
        made += [keyed, alive]
    exact = _exact_map(keyed, alive)
    if not fuzzy:
        return exact
    pairs = similar_titles(alive.select(KEY, "org_key", "title_key").distinct(), similarity, threshold)

    bucket = F.coalesce(F.floor(F.unix_date("start_date") / (days + 1)), F.lit(-(10**9))).cast("long")
    node = F.struct("start_key", "job_id")
    old = (
        alive.select(KEY, "org_key", F.col("title_key").alias("title_old"), F.col("start_date").alias("d_old"), node.alias("a"), bucket.alias("k"))
        .join(pairs, [KEY, "org_key", "title_old"])
        .withColumn("bucket", F.explode(F.array(F.col("k"), F.col("k") + 1)))
    )
    new = alive.select(
        KEY, "org_key", F.col("title_key").alias("title_new"), F.col("start_date").alias("d_new"), node.alias("b"), bucket.alias("bucket")
    )
    edges = old.join(new, [KEY, "org_key", "title_new", "bucket"]).filter(
        (F.col("a") < F.col("b")) & dates_within_days("d_new", "d_old", days)
    )
    merged = absorbed_jobs(edges.select(KEY, "org_key", "a", "b"), days).select(
        KEY, F.col("job_id").alias("canonical_id"), "leader"
    )
    return exact.join(merged, [KEY, "canonical_id"], "left").select(
        KEY, "id", F.coalesce("leader", "canonical_id").alias("canonical_id")
    )


def dedup_education(education: DataFrame, org_map: DataFrame) -> DataFrame:
    return canonical_map(_edu_key(education, org_map), ["k1"], "edu_id", [*ORDER, "edu_id"])


def dedup_certifications(certs: DataFrame) -> DataFrame:
    return canonical_map(_cert_key(certs), ["k1"], "cert_id", [*ORDER, "cert_id"])


# ---------------------------------------------------------------- triples

def _lit(p: str, c: Column, xsd: str = V.XSD_STRING) -> Column:
    return F.struct(F.lit(p).alias("p"), F.nullif(c.cast("string"), F.lit("")).alias("o"), F.lit("literal").alias("o_kind"), F.lit(xsd).alias("o_type"))


def _iri(p: str, c: Column) -> Column:
    return F.struct(F.lit(p).alias("p"), F.nullif(c, F.lit("")).alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_type"))


def _maker(p: str, is_iri: bool) -> Callable[[Column], Column]:
    return lambda x: _iri(p, mint_iri(x)) if is_iri else _lit(p, x)


def _stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def _rows(df: DataFrame, id_col: str, parts: list[Column], lists: list[tuple[str, str, bool]] = ()) -> DataFrame:
    """One pass over an entity table: scalars and lists become triples together."""
    cells = F.array(*parts)
    for p, column, is_iri in lists:
        arr = F.coalesce(F.col(column), F.array().cast("array<string>"))
        cells = F.concat(cells, F.transform(F.array_distinct(arr), _maker(p, is_iri)))
    return (
        df.select(KEY, mint_iri(id_col).alias("s"), F.explode(cells).alias("t"))
        .select(KEY, "s", "t.p", "t.o", "t.o_kind", "t.o_type")
        .filter("o is not null")
    )


def provenance() -> list[Column]:
    return [
        _lit(V.CONFIDENCE, F.col("confidence"), V.XSD_DOUBLE),
        _lit(V.SOURCE_DOC, F.col("source_doc")),
        _lit(V.CREATED_AT, _stamp("created_at"), V.XSD_DATETIME),
    ]


def provenance_triples(df: DataFrame, id_col: str) -> DataFrame:
    return _rows(df, id_col, provenance())


def _base(kind: str, label: str) -> list[Column]:
    return [_iri(V.RDF_TYPE, F.lit(V.TYPE_IRI[kind])), _lit(V.PREF_LABEL, F.col(label)), *provenance()]


def _date(p: str, c: str) -> Column:
    return _lit(p, F.date_format(c, "yyyy-MM-dd"), V.XSD_DATE)


def _bool(p: str, c: Column) -> Column:
    return _lit(p, F.coalesce(c, F.lit(False)), V.XSD_BOOLEAN)


def organization_triples(df: DataFrame) -> DataFrame:
    return _rows(
        df, "org_id",
        [
            *_base("organization", "name"),
            _lit(V.NAME, F.col("name")),
            _lit(V.ONT + "organizationType", F.col("org_type")),
            _lit(V.ONT + "industry", F.col("industry")),
            _lit(V.ADDRESS, F.col("location")),
            _iri(V.SCHEMA + "url", F.col("website")),
            _lit(V.SCHEMA + "description", F.col("description")),
        ],
    )


def skill_triples(df: DataFrame) -> DataFrame:
    return _rows(
        df, "skill_id",
        [
            *_base("skill", "label"),
            _lit(V.DEFINITION, F.col("definition")),
            _iri(V.EXACT_MATCH, F.col("skos_uri")),
            _lit(V.CATEGORY, F.col("category")),
            _lit(V.PROFICIENCY, F.col("proficiency_level")),
            _lit(V.YEARS, F.col("years_experience"), V.XSD_DOUBLE),
        ],
        [(V.BROADER, "broader_concepts", True), (V.NARROWER, "narrower_concepts", True), (V.RELATED, "related_concepts", True)],
    )


def job_triples(df: DataFrame) -> DataFrame:
    return _rows(
        df, "job_id",
        [
            *_base("job", "title"),
            _lit(V.TITLE, F.col("title")),
            _date(V.START, "start_date"),
            _date(V.END, "end_date"),
            _bool(V.IS_CURRENT, F.col("is_current")),
            _lit(V.SCHEMA + "jobLocation", F.col("location")),
            _lit(V.SCHEMA + "description", F.col("description")),
            _iri(V.HIRING_ORG, mint_iri("org_id")),
        ],
        [(V.ACHIEVEMENT, "achievements", False)],
    )


def job_skill_triples(job_skill: DataFrame) -> DataFrame:
    """Usage edges of jobs; ``kind`` is 'skill' or 'technology'."""
    p = F.when(F.col("kind") == "skill", V.USED_SKILL).otherwise(V.USED_TECH)
    return job_skill.select(
        KEY, mint_iri("job_id").alias("s"), p.alias("p"), mint_iri("skill_id").alias("o"),
        F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_type"),
    )


def education_triples(df: DataFrame) -> DataFrame:
    return _rows(
        df, "edu_id",
        [
            *_base("education", "label"),
            _lit(V.DEGREE, F.col("degree_type")),
            _lit(V.FIELD, F.col("field_of_study")),
            _date(V.START, "start_date"),
            _date(V.END, "end_date"),
            _bool(V.IS_CURRENT, F.col("is_current")),
            _lit(V.SCHEMA + "availableAtOrFrom", F.col("location")),
            _lit(V.SCHEMA + "description", F.col("description")),
            _lit(V.ONT + "gpa", F.col("gpa"), V.XSD_DOUBLE),
            _iri(V.RECOGNIZED_BY, mint_iri("institution_id")),
        ],
    )


def certification_triples(df: DataFrame, as_of: Column) -> DataFrame:
    return _rows(
        df, "cert_id",
        [
            *_base("certification", "name"),
            _lit(V.NAME, F.col("name")),
            _lit(V.ONT + "issuingOrganization", F.col("issuing_organization")),
            _date(V.ONT + "issueDate", "issue_date"),
            _date(V.ONT + "expirationDate", "expiration_date"),
            _lit(V.ONT + "credentialId", F.col("credential_id")),
            _iri(V.ONT + "credentialUrl", F.col("credential_url")),
            _bool(V.ONT + "isActive", F.col("is_active")),
            _bool(V.ONT + "isExpired", is_expired("expiration_date", as_of)),
        ],
    )


def person_triples(df: DataFrame) -> DataFrame:
    return _rows(
        df, "person_id",
        [
            *_base("person", "name"),
            _lit(V.NAME, F.col("name")),
            _lit(V.EMAIL, F.col("email")),
            _lit(V.SCHEMA + "telephone", F.col("phone")),
            _lit(V.ADDRESS, F.col("location")),
            _lit(V.SCHEMA + "description", F.col("summary")),
        ],
    )


PERSON_PREDICATE = {
    "job": V.HAS_JOB,
    "skill": V.HAS_SKILL,
    "education": V.ALUMNI_OF,
    "certification": V.HAS_CERT,
}


def person_edges(refs: DataFrame, id_maps: DataFrame) -> DataFrame:
    """Person references (session_id, person_id, kind, id) as edges; unresolved ones are dropped.

    ``id_maps`` is (session_id, kind, id, canonical_id) over all entity kinds.
    """
    p = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in PERSON_PREDICATE.items()])
    return (
        refs.join(id_maps, [KEY, "kind", "id"])
        .select(
            KEY, mint_iri("person_id").alias("s"), p.alias("p"), mint_iri("canonical_id").alias("o"),
            F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_type"),
        )
        .distinct()
    )


def unresolved_person_refs(refs: DataFrame, id_maps: DataFrame) -> DataFrame:
    return refs.join(id_maps, [KEY, "kind", "id"], "left_anti").groupBy(KEY, "kind").agg(F.count("*").alias("skipped"))


def alt_labels(skills: DataFrame, skill_map: DataFrame) -> DataFrame:
    """Alternative labels of every duplicate, attached to the surviving node."""
    alts = skills.select(KEY, F.col("skill_id").alias("id"), F.explode("alt_labels").alias("o")).filter("o <> ''")
    return (
        alts.join(skill_map, [KEY, "id"])
        .select(
            KEY, mint_iri("canonical_id").alias("s"), F.lit(V.ALT_LABEL).alias("p"), "o",
            F.lit("literal").alias("o_kind"), F.lit(V.XSD_STRING).alias("o_type"),
        )
        .distinct()
    )


def survivors(df: DataFrame, id_col: str, id_map: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Rows that carry their own canonical id; a repeated id keeps its first row."""
    keep = id_map.filter("id = canonical_id").select(KEY, F.col("id").alias(id_col))
    row = F.struct(*[c for c in df.columns if c not in (KEY, id_col)])
    out = df.join(keep, [KEY, id_col], "left_semi").groupBy(KEY, id_col).agg(
        F.min_by(row, F.struct(*order)).alias("r")
    )
    return out.select(KEY, id_col, "r.*")


def graph_parts(
    persons: DataFrame,
    person_refs: DataFrame,
    jobs: DataFrame,
    job_skill: DataFrame,
    skills: DataFrame,
    education: DataFrame,
    certifications: DataFrame,
    organizations: DataFrame,
    as_of: Column,
    fuzzy_jobs: bool = True,
    buckets: int | None = None,
    release: Callable[[str], None] | None = None,
) -> Iterator[tuple[DataFrame, list[tuple[DataFrame, str]]]]:
    """The graph in parts, each with the entities it makes nodes of: their table and the name of its id.

    With ``release`` a part is to be written before the next one is asked for: what only earlier parts read is
    deleted then, and ``release`` is told the names of given tables that no later part reads.
    """
    def unify(keyed: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
        firsts = _stored(first_rows(keyed, id_col), buckets)
        return firsts, _stored(id_map(keyed, firsts, id_col), buckets)

    def done(*frames: DataFrame, names: tuple[str, ...] = ()) -> None:
        if release:
            discard(*frames)
            for name in names:
                release(name)

    # A kind has a predicate of its own, so its edges are apart from the others'.
    edges = lambda kind, m: person_edges(person_refs.filter(F.col("kind") == kind), m.withColumn("kind", F.lit(kind)))

    live_skills, skill_map = unify(_skill_key(skills), "skill_id")
    yield skill_triples(live_skills), [(live_skills, "skill_id")]
    done(live_skills)
    yield alt_labels(skills, skill_map).unionByName(edges("skill", skill_map)), []
    done(names=("skills",))

    live_orgs, org_map = unify(_org_key(organizations), "org_id")
    yield organization_triples(live_orgs), [(live_orgs, "org_id")]
    done(live_orgs, names=("organizations",))

    made: list[DataFrame] = []
    job_map = _stored(dedup_jobs(jobs, org_map, fuzzy=fuzzy_jobs, buckets=buckets, made=made), buckets)
    discard(*made)
    kept_jobs = job_map.filter("id = canonical_id").select(KEY, F.col("id").alias("job_id"))
    usage = job_skill.select(KEY, "job_id", "skill_id", "kind").join(kept_jobs, [KEY, "job_id"], "left_semi")
    yield job_skill_triples(canonical_refs(usage, "skill_id", skill_map).distinct()), []
    done(skill_map, names=("job_skill",))
    live_jobs = jobs.join(kept_jobs, [KEY, "job_id"], "left_semi")
    yield job_triples(canonical_refs(live_jobs, "org_id", org_map)).unionByName(edges("job", job_map)), [(live_jobs, "job_id")]
    done(job_map, names=("jobs",))

    live_edus, edu_map = unify(_edu_key(education, org_map), "edu_id")
    live_certs, cert_map = unify(_cert_key(certifications), "cert_id")
    rest = education_triples(canonical_refs(live_edus, "institution_id", org_map))
    for part in (certification_triples(live_certs, as_of), person_triples(persons), edges("education", edu_map), edges("certification", cert_map)):
        rest = rest.unionByName(part)
    yield rest, [(live_edus, "edu_id"), (live_certs, "cert_id"), (persons, "person_id")]


def build_graph(*tables: DataFrame, **options) -> DataFrame:
    """All sessions' graphs as one triples DataFrame with set semantics, from the tables that ``graph_parts`` names.

    ``persons`` holds one merged person per session (see ``merge_persons``).
    With ``buckets`` intermediate tables are bucketed by session, as the given ones should be then.
    """
    out = ids = None
    for part, own in graph_parts(*tables, **options):
        out = part if out is None else out.unionByName(part)
        for df, c in own:
            hashes = df.select(F.xxhash64(KEY, c).alias("h"))
            ids = hashes if ids is None else ids.unionByName(hashes)
    # Lists and edges are distinct already, so only an id that names two entities
    # could repeat a statement. Looking for one is far cheaper than shuffling all triples.
    # Equal hashes of different ids cost the shuffle and change nothing.
    clash = ids.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    return out if clash.isEmpty() else out.distinct()


def store_parts(parts: Iterator[tuple[DataFrame, list]], buckets: int) -> DataFrame:
    """``store`` of a graph that comes in parts, each written before the next one is worked out."""
    out = None
    for part, _ in parts:
        out = cut_by(part, KEY, sort=("p", KEY, "s"), buckets=buckets, placed=True, codec="zstd", onto=out)
    # As in ``build_graph``: an entity has one type, so an id that names two has two.
    clash = out.filter(F.col("p") == V.RDF_TYPE).groupBy(KEY, "s").agg(F.count("*").alias("n")).filter("n > 1")
    if clash.isEmpty():
        return out
    whole = store(out.distinct(), buckets)
    discard(out)
    return whole


def store(triples: DataFrame, buckets: int | None = None) -> DataFrame:
    """The graph as a table bucketed by session and subject and sorted by predicate.

    Whatever is asked per node, or joined with nodes, reads it where it lies;
    a filter on predicates reads the pages that have them. A bucket per shuffle
    partition: what the optimiser expects of so many joins is no guide. A graph built
    in ``buckets`` lies by session, and is written so without moving a triple.
    """
    if buckets:
        return cut_by(triples, KEY, sort=("p", KEY, "s"), buckets=buckets, placed=True, codec="zstd")
    buckets = int(triples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_by(triples, KEY, "s", sort=("p", KEY, "s"), buckets=buckets, codec="zstd")


# ---------------------------------------------------------------- queries over the graph

def graph_stats(triples: DataFrame) -> DataFrame:
    """Triples and nodes per type, one row per session."""
    is_type = F.col("p") == V.RDF_TYPE
    return triples.groupBy(KEY).agg(
        F.count("*").alias("triple_count"),
        *[F.count_if(is_type & (F.col("o") == iri)).alias(f"{kind}_count") for kind, iri in V.TYPE_IRI.items()],
    )


def match_pattern(triples: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Basic graph pattern: terms starting with '?' are variables, shared ones join.

    Each pattern is filtered and projected before it is joined, within a session.
    """
    out = None
    for pattern in patterns:
        names, df = {}, triples
        for col, term in zip(("s", "p", "o"), pattern):
            if not term.startswith("?"):
                df = df.filter(F.col(col) == term)
            elif term[1:] in names:
                df = df.filter(F.col(col) == F.col(names[term[1:]]))
            else:
                names[term[1:]] = col
        df = df.select(KEY, *[F.col(c).alias(n) for n, c in names.items()])
        shared = [n for n in names if out is not None and n in out.columns]
        if out is not None and names and not shared:
            raise ValueError(f"pattern {pattern} shares no variable with those before it: order the patterns so that each does")
        out = df if out is None else out.join(df, [KEY, *shared])
    return out


def skills_in_jobs_titled(triples: DataFrame, text: str) -> DataFrame:
    """Skills used in jobs whose title contains ``text``, case ignored."""
    rows = match_pattern(
        triples.filter((F.col("p") != V.TITLE) | F.contains(F.lower("o"), F.lit(text.lower()))),
        [
            ("?job", V.TITLE, "?title"),
            ("?job", V.RDF_TYPE, V.TYPE_IRI["job"]),
            ("?job", V.USED_SKILL, "?skill"),
            ("?skill", V.PREF_LABEL, "?label"),
        ],
    )
    return rows.select(KEY, "skill", "label").distinct()


def unowned_used_skills(triples: DataFrame) -> DataFrame:
    """Used skills that no person of the session claims."""
    used = triples.filter(F.col("p") == V.USED_SKILL).select(KEY, F.col("o").alias("skill"))
    owned = triples.filter(F.col("p") == V.HAS_SKILL).select(KEY, F.col("o").alias("skill"))
    return used.distinct().join(owned, [KEY, "skill"], "left_anti")
