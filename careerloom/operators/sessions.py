"""Sessions, uploads and corrections.

documents: session_id, document_id, filename, upload_ts, status, file_hash
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careerloom.functions import case_key, strip
from careerloom.operators.common import KEY
from careerloom.sources.versions import VersionedTables

# Fixed rules of the upload path.
ALLOWED_EXTENSIONS = (".pdf", ".docx", ".doc", ".txt", ".md")
MAX_DOCUMENTS = 10
MUTABLE_FIELDS = ("label", "user_verified", "user_notes")
STATUSES = ("pending", "processing", "complete", "error")
ANALYSIS_TYPES = (
    "skill_gap", "career_topology", "tech_evolution", "hierarchy_map", "esco_coverage", "role_progression"
)
NARRATIVE_TYPES = ("conservative", "exploratory")


def completed_entities(entities: DataFrame, documents: DataFrame) -> DataFrame:
    """Entity rows of completed documents; sessions without one drop out."""
    done = documents.filter("status = 'complete'").select(KEY, F.col("document_id").alias("doc_id"))
    return entities.join(done, [KEY, "doc_id"], "left_semi")


def name_key(by_name: bool) -> Column:
    return case_key("name") if by_name else F.lit("")


def merge_persons(persons: DataFrame, sessions: DataFrame | None = None, by_name: bool = False) -> DataFrame:
    """One person per session, identity from the first document.

    ``by_name`` keeps persons with different names apart. Sessions without any
    person get one called Unknown when ``sessions`` is given.
    """
    row = F.struct(*[c for c in persons.columns if c != KEY])
    out = (
        persons.withColumn("_k", name_key(by_name))
        .groupBy(KEY, "_k")
        .agg(F.min_by(row, F.struct("doc_id", "person_id")).alias("r"))
        .select(KEY, "r.*")
    )
    if sessions is None:
        return out
    missing = sessions.select(KEY).distinct().join(out.select(KEY), KEY, "left_anti")
    fill = {"person_id": F.concat(F.lit("unknown-"), F.col(KEY).cast("string")), "name": F.lit("Unknown"), "confidence": F.lit(1.0)}
    return out.unionByName(missing.select(KEY, *[c.alias(n) for n, c in fill.items()]), allowMissingColumns=True)


def merged_references(refs: DataFrame, persons: DataFrame, by_name: bool = False) -> DataFrame:
    """Union of all documents' references, re-pointed at the merged person."""
    who = persons.select(KEY, "person_id", name_key(by_name).alias("_k"))
    lead = persons.select(KEY, "doc_id", "person_id", name_key(by_name).alias("_k")).groupBy(KEY, "_k").agg(
        F.min_by("person_id", F.struct("doc_id", "person_id")).alias("lead")
    )
    return (
        refs.join(who, [KEY, "person_id"])
        .join(lead, [KEY, "_k"])
        .select(KEY, F.col("lead").alias("person_id"), "kind", "id")
        .distinct()
    )


def duplicate_uploads(uploads: DataFrame) -> DataFrame:
    """Uploads whose content already arrived in the session, with the first document.

    The first of each content is an aggregate joined back, so a content copied
    into a third of all rows is combined before the shuffle and split in the join.
    """
    order = F.struct("upload_ts", "document_id")
    firsts = uploads.groupBy(KEY, "file_hash").agg(
        F.min_by("document_id", order).alias("duplicate_of"), F.min_by("filename", order).alias("duplicate_filename")
    )
    return (
        uploads.join(firsts, [KEY, "file_hash"])
        .filter("document_id <> duplicate_of")
        .select(KEY, "document_id", "filename", "duplicate_of", "duplicate_filename")
    )


def admit_documents(uploads: DataFrame, limit: int = MAX_DOCUMENTS) -> DataFrame:
    """Admission decision per upload: accepted, or rejected with its reason.

    In upload order: contents already seen and foreign extensions are refused,
    then the first ``limit`` of the session are taken. The limit is a top-k per
    session, which Spark prunes before the shuffle.
    """
    ext = F.lower(F.regexp_extract("filename", r"(\.[^.]*)$", 1))
    dup = duplicate_uploads(uploads).select(KEY, "document_id", F.lit(True).alias("dup"))
    judged = uploads.join(dup, [KEY, "document_id"], "left").withColumn(
        "reason",
        F.when(F.col("dup"), "duplicate").when(~ext.isin(*ALLOWED_EXTENSIONS), "unsupported_type"),
    )
    rank = F.row_number().over(Window.partitionBy(KEY).orderBy("upload_ts", "document_id"))
    taken = (
        judged.filter("reason is null").withColumn("rk", rank).filter(F.col("rk") <= limit)
        .select(KEY, "document_id", F.lit(True).alias("taken"))
    )
    reason = F.coalesce("reason", F.when(F.col("taken").isNull(), "session_limit"))
    return judged.join(taken, [KEY, "document_id"], "left").select(
        KEY, "document_id", "filename", F.coalesce("taken", F.lit(False)).alias("accepted"), reason.alias("reason")
    )


def list_sessions(sessions: DataFrame, documents: DataFrame, top: int | None = None) -> DataFrame:
    """Sessions with their document count, newest first; ``top`` keeps that many."""
    counts = documents.groupBy(KEY).agg(F.count("*").alias("document_count"))
    out = (
        sessions.join(counts, KEY, "left")
        .withColumn("document_count", F.coalesce("document_count", F.lit(0).cast("long")))
        .orderBy(F.desc("updated_at"), KEY)
    )
    return out.limit(top) if top else out


def storage_stats(sessions: DataFrame, documents: DataFrame) -> DataFrame:
    s = sessions.agg(F.count("*").alias("total_sessions"))
    d = documents.agg(
        F.count("*").alias("total_documents"),
        *[F.count_if(F.col("status") == x).alias(f"{x}_documents") for x in STATUSES],
    )
    # Two one-row frames.
    return s.withColumn("_one", F.lit(1)).join(d.withColumn("_one", F.lit(1)), "_one").drop("_one")


def session_stats(sessions: DataFrame, documents: DataFrame, graph_counts: DataFrame) -> DataFrame:
    """Documents by status, entities in the deduplicated graph, and what to do next."""
    zero = F.lit(0).cast("long")
    docs = documents.groupBy(KEY).agg(
        F.count("*").alias("total_documents"),
        *[F.count_if(F.col("status") == x).alias(x) for x in STATUSES],
    )
    hint = (
        F.when(F.col("complete") > 0, F.lit(None))
        .when(F.col("total_documents") == 0, "This session has no document yet: add one.")
        .when(F.col("processing") + F.col("pending") > 0, "Documents are still being read: try again later.")
        .when(
            F.col("error") > 0,
            "No document could be read: see the error message of each.",
        )
        .otherwise("This session has no document yet: add one.")
    )
    counts = [c for c in graph_counts.columns if c != KEY]
    out = sessions.select(KEY).join(docs, KEY, "left").join(graph_counts, KEY, "left")
    fill = [F.coalesce(c, zero).alias(c) for c in ("total_documents", *STATUSES)]
    ready = F.col("complete") > 0
    return out.select(KEY, *fill, *counts).select(
        KEY, "total_documents", *STATUSES,
        *[F.when(ready, F.coalesce(c, zero)).otherwise(zero).alias(c) for c in counts],
        hint.alias("hint"),
    )


# ---------------------------------------------------------------- corrections

def check_edits(edits: DataFrame) -> DataFrame:
    """Add ``reject``: unknown field, blank label, or nothing to change."""
    names = F.map_keys("patch")
    unknown = F.size(F.array_except(names, F.array(*[F.lit(f) for f in MUTABLE_FIELDS]))) > 0
    label = F.try_element_at("patch", F.lit("label"))
    blank = F.array_contains(names, "label") & (F.coalesce(strip(label), F.lit("")) == "")
    return edits.withColumn(
        "reject",
        F.when(unknown, "unknown_field").when(blank, "blank_label").when(F.size(names) == 0, "no_fields"),
    )


def apply_corrections(entities: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patch entities by id, and rename same-labelled ones in the session's other documents.

    entities: session_id, doc_id, kind, entity_id, label, user_verified, user_notes, alt_labels
    edits:    session_id, kind, entity_id, patch map<string,string>, seq
    A field is a register: of several edits the one with the largest ``seq`` counts (ties: the greater value), so a
    later edit wins whatever came in between. Renamings by label follow the same order.
    Returns (entities, rejected or unmatched edits with a reason).
    """
    judged = check_edits(edits)
    fields = judged.filter("reject is null").select(KEY, "kind", "entity_id", "seq", F.explode("patch").alias("f", "v"))
    fields = fields.groupBy(KEY, "kind", "entity_id", "f").agg(
        F.max_by("v", F.struct("seq", "v")).alias("v"), F.max("seq").alias("seq")
    )
    good = fields.groupBy(KEY, "kind", "entity_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("f", "v")))).alias("patch"), F.max("seq").alias("seq")
    )
    hits = good.join(entities.select(KEY, "kind", "entity_id", "doc_id", "label"), [KEY, "kind", "entity_id"])
    primary = good.select(KEY, "kind", "entity_id", F.col("patch").alias("p1"))
    # By label: only where the patch renames, and not in a document the id was found in.
    rename = hits.filter(F.array_contains(F.map_keys("patch"), "label") & (F.col("kind") != "person"))
    k = case_key("label").alias("k")
    secondary = rename.groupBy(KEY, "kind", k).agg(F.max_by("patch", F.struct("seq", "entity_id")).alias("p2"))
    home = rename.select(KEY, "kind", k, "doc_id", F.lit(True).alias("home")).distinct()
    e = (
        entities.withColumn("k", k)
        .join(primary, [KEY, "kind", "entity_id"], "left")
        .join(secondary, [KEY, "kind", "k"], "left")
        .join(home, [KEY, "kind", "k", "doc_id"], "left")
    )
    patch = F.coalesce("p1", F.when(F.col("home").isNull(), F.col("p2")))
    value = lambda f: F.try_element_at("_patch", F.lit(f))
    alts = F.coalesce("alt_labels", F.array().cast("array<string>"))
    renamed = F.coalesce((F.col("kind") == "skill") & (value("label") != F.col("label")), F.lit(False))
    out = e.withColumn("_patch", patch).select(
        KEY, "doc_id", "kind", "entity_id",
        F.coalesce(value("label"), "label").alias("label"),
        F.coalesce(value("user_verified").cast("boolean"), "user_verified").alias("user_verified"),
        F.coalesce(value("user_notes"), "user_notes").alias("user_notes"),
        F.when(renamed & ~F.array_contains(alts, F.col("label")), F.array_append(alts, F.col("label"))).otherwise(alts).alias("alt_labels"),
    )
    missing = good.join(hits.select(KEY, "kind", "entity_id"), [KEY, "kind", "entity_id"], "left_anti")
    refused = judged.filter("reject is not null").select(KEY, "kind", "entity_id", F.col("reject").alias("reason")).unionByName(
        missing.select(KEY, "kind", "entity_id", F.lit("not_found").alias("reason"))
    )
    return out, refused


# ---------------------------------------------------------------- upkeep

def stale_sessions(documents: DataFrame, graphs: DataFrame) -> DataFrame:
    """Sessions whose graph is missing or older than a completed document's entities.

    documents carry ``entity_ts``; graphs: session_id, graph_ts.
    """
    newest = documents.filter("status = 'complete'").groupBy(KEY).agg(F.max("entity_ts").alias("entity_ts"))
    return newest.join(graphs, KEY, "left").filter("graph_ts is null or entity_ts > graph_ts").select(
        KEY, "entity_ts", "graph_ts"
    )


def insight_status(sessions: DataFrame, insights: DataFrame) -> DataFrame:
    """Every analysis and narrative type of every session, and whether it exists."""
    kinds = F.array(
        *[F.struct(F.lit("analysis").alias("family"), F.lit(t).alias("analysis_type")) for t in ANALYSIS_TYPES],
        *[F.struct(F.lit("narrative").alias("family"), F.lit(t).alias("analysis_type")) for t in NARRATIVE_TYPES],
    )
    wanted = sessions.select(KEY, F.explode(kinds).alias("k")).select(KEY, "k.*")
    return wanted.join(insights.select(KEY, "analysis_type", "content"), [KEY, "analysis_type"], "left").select(
        KEY, "family", "analysis_type", F.col("content").isNotNull().alias("available"), "content"
    )


def insight_totals(status: DataFrame) -> DataFrame:
    a = F.col("available")
    return status.groupBy(KEY).agg(
        F.count_if(a & (F.col("family") == "analysis")).alias("insights_available"),
        F.count_if(F.col("family") == "analysis").alias("insights_total"),
        F.max(a & (F.col("analysis_type") == "conservative")).alias("narratives_conservative"),
        F.max(a & (F.col("analysis_type") == "exploratory")).alias("narratives_exploratory"),
    )


def inspect_documents(documents: DataFrame, jobs: DataFrame, skills: DataFrame, n_jobs: int = 5, n_skills: int = 10) -> DataFrame:
    """Per document the first jobs and skills, and how many more there are."""

    def head(df: DataFrame, label: Column, order: list[str], n: int, name: str) -> DataFrame:
        w = Window.partitionBy(KEY, "doc_id").orderBy(*order)
        top = df.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= n)
        shown = top.groupBy(KEY, "doc_id").agg(
            F.array_sort(F.collect_list(F.struct("rk", label.alias("t")))).alias("l")
        ).select(KEY, "doc_id", F.array_join(F.transform("l", lambda x: x.t), "; ").alias("shown"))
        total = df.groupBy(KEY, "doc_id").agg(F.count("*").alias("n"))
        more = F.when(F.col("n") > n, F.concat(F.lit("; +"), (F.col("n") - n).cast("string"), F.lit(" more"))).otherwise("")
        return shown.join(total, [KEY, "doc_id"]).select(
            KEY, "doc_id", F.col("n").alias(f"n_{name}"), F.concat("shown", more).alias(name)
        )

    job_text = F.concat("title", F.lit(" at "), F.coalesce("org_id", F.lit("N/A")))
    j = head(jobs, job_text, ["pos", "job_id"], n_jobs, "jobs")
    s = head(skills, F.col("label"), ["label", "skill_id"], n_skills, "skills")
    zero = F.lit(0).cast("long")
    return (
        documents.select(KEY, "doc_id")
        .join(j, [KEY, "doc_id"], "left")
        .join(s, [KEY, "doc_id"], "left")
        .select(
            KEY, "doc_id", F.coalesce("n_jobs", zero).alias("n_jobs"), F.coalesce("jobs", F.lit("")).alias("jobs"),
            F.coalesce("n_skills", zero).alias("n_skills"), F.coalesce("skills", F.lit("")).alias("skills"),
        )
    )


def latest_session(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.max_by(F.struct(KEY, "updated_at"), F.struct("updated_at", KEY)).alias("r")).select("r.*")


def purge_sessions(tables: VersionedTables, version: int, gone: DataFrame, names: Sequence[str]) -> None:
    """Take sessions out of all their tables at once.

    One commit names the sessions and gives them no rows: readers see none from
    then on, in any of the tables, and the next compaction leaves them out for good.
    """
    none = {name: tables.read(name).limit(0) for name in names}
    tables.commit(version, gone, **none)
