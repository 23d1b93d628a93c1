"""The battery of six analyses, packaged as insight documents."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerloom.operators.common import KEY, keep, stored
from careerloom.plans import render as R
from careerloom.plans import texts as TX
from careerloom.runtime import cut, discard

Frames = Mapping[str, DataFrame]

# analysis type -> lines of all persons. Register further ones here.
ANALYZERS: dict[str, Callable[[Frames], DataFrame]] = {
    "skill_gap": lambda f: R.render_skill_gap(f["persons"], f["jobs"], f["skills"], f["tech"]),
    "career_topology": lambda f: R.render_topology(f["persons"], f["jobs"], f["tech"]),
    "tech_evolution": lambda f: R.render_evolution(f["persons"], f["jobs"], f["tech"]),
    "hierarchy_map": lambda f: R.render_hierarchy(f["persons"], f["skills"], f["matches"]),
    "esco_coverage": lambda f: R.render_coverage(f["persons"], f["skills"]),
    "role_progression": lambda f: R.render_progression(f["persons"], f["jobs"]),
}


def register_analyzer(name: str, title: str, tags: tuple, hints: tuple, run: Callable[[Frames], DataFrame]) -> None:
    """Add an analysis: ``run`` maps the frames to lines (see ``render.lines``)."""
    TX.INSIGHTS[name] = (title, tags, hints)
    ANALYZERS[name] = run


def _metadata(frames: Frames) -> DataFrame:
    count = lambda n, c: frames[n].groupBy(KEY).agg(F.count("*").alias(c))
    zero = F.lit(0).cast("long")
    out = frames["persons"].select(KEY, "person_name", "source_document")
    for frame, c in (("nodes", "entity_count"), ("jobs", "job_count"), ("skills", "skill_count")):
        out = out.join(count(frame, c), KEY, "left").withColumn(c, F.coalesce(c, zero))
    return out


def package_insight(
    content: DataFrame, frames: Frames, analysis_type: str, analysis_date: Column, metadata: DataFrame | None = None
) -> DataFrame:
    """Content (session_id, content) with title, tags, hints, counts and date."""
    title, tags, hints = TX.INSIGHTS[analysis_type]
    words = lambda xs: F.array(*[F.lit(x) for x in xs])
    return content.join(_metadata(frames) if metadata is None else metadata, KEY).select(
        KEY,
        F.lit(analysis_type).alias("analysis_type"),
        F.lit(title).alias("title"),
        "content",
        F.col("source_document").alias("source_file"),
        "person_name",
        analysis_date.cast("string").alias("analysis_date"),
        words(tags).alias("tags"),
        words(hints).alias("query_hints"),
        "entity_count",
        "job_count",
        "skill_count",
    )


def insight_lines(frames: Frames, types: list[str] | None = None) -> DataFrame:
    """Lines of all documents: the form that scales to any career."""
    return R.union(*[ANALYZERS[t](frames).withColumn("analysis_type", F.lit(t)) for t in types or ANALYZERS])


def run_battery(
    frames: Frames, analysis_date: Column, types: list[str] | None = None, buckets: int | None = None
) -> tuple[DataFrame, dict[str, str]]:
    """All analyses for all persons, one document each: a view of ``insight_lines``.

    Every analysis is written on its own, so one that fails while planning or
    while running is reported and leaves the others whole. ``buckets``: that of
    frames that lie by session. The parts of an analysis then do so as well, but
    Spark forgets it in their union: lines are written from where they are.
    """
    metadata = stored(_metadata(frames), buckets)
    docs, failed = [], {}
    for t in types or list(ANALYZERS):
        try:
            rows = ANALYZERS[t](frames)
            placed = [] if buckets is None else [keep(rows, buckets, placed=True)]
            content = R.assemble_text(*placed or [rows])
            docs.append(cut(package_insight(content, frames, t, analysis_date, metadata), codec="zstd"))
            discard(*placed)
        except Exception as e:  # noqa: BLE001
            failed[t] = str(e)
    if not docs:
        raise RuntimeError(f"all analyses failed: {failed}")
    return R.union(*docs), failed


def to_markdown(insights: DataFrame) -> DataFrame:
    """(session_id, analysis_type, markdown): front matter, heading and content."""
    bullets = lambda c: F.transform(F.col(c), lambda x: F.concat(F.lit('  - "'), x, F.lit('"')))
    kv = lambda k, c: F.concat(F.lit(f"{k}: "), F.col(c).cast("string"))
    rows = F.concat(
        F.array(
            F.lit("---"), kv("analysis_type", "analysis_type"), F.concat(F.lit('title: "'), "title", F.lit('"')),
            kv("source_file", "source_file"), kv("person_name", "person_name"), kv("analysis_date", "analysis_date"),
            F.lit("tags:"),
        ),
        bullets("tags"), F.array(F.lit("query_hints:")), bullets("query_hints"),
        F.array(
            kv("entity_count", "entity_count"), kv("job_count", "job_count"), kv("skill_count", "skill_count"),
            F.lit("---"), F.lit(""), F.concat(F.lit("# "), "title"), F.lit(""), F.col("content"),
        ),
    )
    return insights.select(KEY, "analysis_type", F.array_join(rows, "\n").alias("markdown"))


def retrieval_entries(insights: DataFrame) -> DataFrame:
    """Flat rows for a vector store; the id names session and analysis."""
    return insights.select(
        F.concat_ws(":", F.col(KEY).cast("string"), "analysis_type").alias("id"),
        F.col("content").alias("document"),
        "analysis_type", "title", "source_file", "person_name", "analysis_date",
        F.lit("graph_analysis").alias("source"),
    )


def upsert_entries(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace old ones of the same id."""
    return old.join(new.select("id"), "id", "left_anti").unionByName(new)
