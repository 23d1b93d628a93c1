"""Streams driven to completion over the event table in several batches; SQL states the result."""

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from careerloom.operators import graph, normalize
from careerloom.operators.common import keep
from careerloom.operators.sessions import ANALYSIS_TYPES
from careerloom.plans import insights
from careerloom.plans.queries.registry import query
from careerloom.plans.queries.texts import _DATE, _packed
from careerloom.runtime import shared_dir
from careerloom.streaming import feeds, status


def _folders(c) -> tuple[str, str]:
    base = f"{shared_dir(c.spark)}/stream-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


def _text(ts: str):
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias(ts)


@query(
    "document_status",
    "SELECT session_id, document_id, status, strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS last_ts, n_events FROM doc_status",
)
def _(c):
    return c.doc_status.withColumn("last_ts", _text("last_ts"))


# The payload of a progress event is how far it is.
_RUNS = """
    WITH e AS (
        SELECT *, CASE event WHEN 'progress' THEN CAST(json_extract(payload, '$.k') AS INTEGER) WHEN 'complete' THEN 100 END AS told,
               lag(event) OVER w AS event_0, lag(ts) OVER w AS ts_0
        FROM event WINDOW w AS (PARTITION BY session_id, document_id ORDER BY ts, event_id)
    ), r AS (
        SELECT *, sum(CASE WHEN event_0 IN ('complete', 'error') AND ts > ts_0 + INTERVAL 1 day THEN 1 ELSE 0 END)
               OVER (PARTITION BY session_id, document_id ORDER BY ts, event_id) AS run FROM e
    ), d AS (
        SELECT session_id, document_id, run, last(status ORDER BY ts, event_id) AS status,
               coalesce(last(told ORDER BY ts, event_id) FILTER (told IS NOT NULL), 0) AS progress,
               last(payload ORDER BY ts, event_id) FILTER (event = 'error') AS error_message,
               min(ts) AS started_at, max(ts) AS last_ts, count(*) AS n_events
        FROM r GROUP BY 1, 2, 3
    ), s AS (SELECT * EXCLUDE (run) FROM d QUALIFY row_number() OVER (PARTITION BY session_id, document_id ORDER BY run DESC) = 1)
"""
_STATUS = """session_id, document_id, status, progress, error_message, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at,
    strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS last_ts, n_events"""


def _with(sql: str, tail: str) -> str:
    """A query of its own WITH list, as a part of a composed one."""
    return f"SELECT * FROM ({sql} {tail})"


def _progress(events):
    told = F.concat(F.lit('{"progress": '), F.get_json_object("payload", "$.k"), F.lit("}"))
    return events.withColumn("payload", F.when(F.col("event") == "progress", told).otherwise(F.col("payload")))


@query("document_runs", _with(_RUNS, f"SELECT {_STATUS} FROM s"))
def _(c):
    runs = status.document_runs(_progress(c.events))
    return runs.withColumns({"started_at": _text("started_at"), "last_ts": _text("last_ts")})


def _streamed_status(c):
    out, ckpt = _folders(c)
    status.stream_document_status(_progress(c.event_stream()), out, ckpt, keep=timedelta(days=1)).awaitTermination()
    return status.current_status(c.spark, out)


@query("stream_document_status", _with(_RUNS, f"SELECT {_STATUS} FROM s"))
def _(c):
    return _streamed_status(c).withColumns({"started_at": _text("started_at"), "last_ts": _text("last_ts")})


@query(
    "session_changes",
    _with(
        _RUNS,
        """SELECT session_id, strftime(max(last_ts), '%Y-%m-%d %H:%M:%S') AS updated_at, count(*) FILTER (status = 'complete') AS complete,
           count(*) FILTER (status = 'error') AS error, count(*) AS documents FROM s GROUP BY 1""",
    ),
)
def _(c):
    return status.session_changes(_streamed_status(c)).withColumn("updated_at", _text("updated_at"))


@query(
    "stream_dedup_uploads",
    """SELECT session_id, md5(payload) AS file_hash, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS upload_ts, first(event_id ORDER BY ts, event_id) AS document_id
       FROM event GROUP BY 1, 2""",
)
def _(c):
    out, ckpt = _folders(c)
    stream = c.event_stream().select("session_id", F.md5("payload").alias("file_hash"), F.col("ts").alias("upload_ts"), F.col("event_id").alias("document_id"))
    feeds.stream_dedup_uploads(stream, out, ckpt).awaitTermination()
    return feeds.first_uploads(c.spark, out).withColumn("upload_ts", _text("upload_ts"))


_COUNTS = "count(*) AS n_events, count(DISTINCT (session_id, document_id)) AS n_documents"


@query(
    "event_counts",
    f"SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event, {_COUNTS} FROM event GROUP BY 1, 2",
)
def _(c):
    return feeds.event_counts(c.events, delay=None).withColumn("window_start", _text("window_start"))


@query(
    "stream_event_counts",
    f"""SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event, {_COUNTS}
       FROM (SELECT time_bucket(INTERVAL 1 hour, ts) AS w, event, session_id, document_id FROM event)
       WHERE w + INTERVAL 1 hour <= (SELECT max(ts) FROM event) - INTERVAL 10 minutes GROUP BY 1, 2""",
)
def _(c):
    # Append mode keeps back the windows that the watermark has not closed.
    out, ckpt = _folders(c)
    feeds.stream_event_counts(c.event_stream(), out, ckpt).awaitTermination()
    return c.spark.read.parquet(out).withColumn("window_start", _text("window_start"))


_READY = "SELECT document_id FROM event WHERE event = 'complete' GROUP BY 1 HAVING count(*) >= 2"


@query(
    "stream_rebuild",
    f"""SELECT * FROM (
        SELECT session_id, 'triple' AS part, s || ' ' || p AS k, o || ' ' || o_kind || ' ' || coalesce(o_type, '') AS v FROM n_triple
        UNION ALL SELECT session_id, 'label', pool || ':' || label, canonical || ' ' || phase FROM label_map
        UNION ALL SELECT session_id, 'insight', analysis_type, md5(content) FROM ({' UNION ALL '.join(_packed(k) for k in ANALYSIS_TYPES)})
    ) WHERE session_id IN ({_READY})""",
)
def _(c):
    """Finished uploads reconcile the labels of their sessions, rebuild the graphs and run the analyses anew; here a user's
    uploads belong to the session of the same number."""
    out, ckpt = _folders(c)
    # Records lie by session, and both batches read them; all but the lines' own columns is made of the stored lines.
    c.store("persons", "line", "job", "raw_skill", "raw_edu", "raw_org", "raw_cert", "raw_person", "raw_refs", "merged_person", "skill", "tech", "matches")

    def rebuild(touched):
        of = lambda df: df.join(touched, "session_id", "left_semi")
        skills, orgs, education = of(c.raw_skill), of(c.raw_org), of(c.raw_edu)
        pools = keep(normalize.label_pools(skills.filter("declared"), of(c.raw_tech), orgs, education), c.buckets)
        labels = keep(normalize.build_label_map(pools, of(c.alias_groups)), c.buckets)
        triples = graph.build_graph(
            of(c.merged_person), of(c.merged_refs), of(c.job), of(c.job_skill), normalize.apply_to_skills(skills, labels),
            normalize.apply_to_education(education, labels), of(c.raw_cert), normalize.apply_to_orgs(orgs, labels), c.as_of,
            buckets=c.buckets,
        )
        frames = {k: of(df) if "session_id" in df.columns else df for k, df in c.career_frames().items()}
        docs, failed = insights.run_battery(frames, F.lit(_DATE), buckets=c.buckets)
        if failed:
            raise RuntimeError(f"analyses failed: {failed}")
        return {"labels": labels, "triples": triples, "insights": docs}

    done = c.event_stream(parts=2).filter("event = 'complete'").select(F.col("document_id").alias("session_id"))
    ready = lambda: c.events.filter("event = 'complete'").select(F.col("document_id").alias("session_id"))
    feeds.stream_rebuild(done, rebuild, out, ckpt, completed=ready).awaitTermination()
    latest = lambda name, k, v: feeds.latest_rows(c.spark, out, name).select(
        "session_id", F.lit(name.removesuffix("s")).alias("part"), k.alias("k"), v.alias("v")
    )
    return (
        latest("triples", F.concat_ws(" ", "s", "p"), F.concat_ws(" ", "o", "o_kind", F.coalesce("o_type", F.lit(""))))
        .unionByName(latest("labels", F.concat_ws(":", "pool", "label"), F.concat_ws(" ", "canonical", "phase")))
        .unionByName(latest("insights", F.col("analysis_type"), F.md5("content")))
    )
