"""Scoring extractions against gold labels.

Items are long rows: doc_id, etype, text (bare strings) or label, name, title,
degree_type, field_of_study.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careerloom.functions import (
    case_key, email_domains, first_nonempty, match_key, org_match_key, prf, ratio, secret_flags,
)
from careerloom.functions.text import SYNTHETIC_DOMAINS
from careerloom.operators.common import digits_first

# Fixed order of the report and fixed quality floors.
REPORT_TYPES = ("person", "certifications", "education", "jobs", "organizations", "skills")
LIST_TYPES = REPORT_TYPES[1:]
SKILL_RECALL_MIN = 0.80
SKILL_PRECISION_MIN = 0.70
JOB_RECALL_MIN = 0.75
ORG_RECALL_MIN = 0.75


def eval_key() -> Column:
    pick = lambda *c: F.coalesce(first_nonempty("text", *c), F.lit(""))
    degree = F.concat(match_key("degree_type"), F.lit("|"), match_key("field_of_study"))
    etype = F.col("etype")
    return (
        F.when(etype == "skills", match_key(pick("label", "name")))
        .when(etype == "jobs", match_key(pick("title", "label")))
        .when(etype == "certifications", match_key(pick("name", "label")))
        .when(etype == "organizations", org_match_key(pick("name", "label")))
        .when((etype == "education") & F.col("text").isNotNull(), match_key("text"))
        .when(etype == "education", degree)
    )


def eval_keys(items: DataFrame) -> DataFrame:
    """Distinct comparison keys per document and type; blanks drop out."""
    return items.select("doc_id", "etype", eval_key().alias("key")).filter("key <> ''").distinct()


def eval_detail(extracted: DataFrame, gold: DataFrame) -> DataFrame:
    """Every key as matched, missing or unexpected, from one aggregation."""
    side = F.sum("side")
    status = F.when(side == 3, "matched").when(side == 1, "unexpected").otherwise("missing")
    return (
        extracted.select("doc_id", "etype", "key", F.lit(1).alias("side"))
        .unionByName(gold.select("doc_id", "etype", "key", F.lit(2).alias("side")))
        .groupBy("doc_id", "etype", "key")
        .agg(status.alias("status"))
    )


def eval_person(extracted: DataFrame, gold: DataFrame) -> DataFrame:
    """Person names as detail rows; documents whose gold has no name are left out."""
    g = gold.select("doc_id", match_key("name").alias("want")).filter("want <> ''")
    e = extracted.select("doc_id", match_key("name").alias("got"))
    both = g.join(e, "doc_id", "left").withColumn("got", F.coalesce("got", F.lit("")))
    row = lambda k, s: F.struct(F.col(k).alias("key"), F.lit(s).alias("status"))
    rows = F.when(F.col("want") == F.col("got"), F.array(row("want", "matched"))).otherwise(
        F.filter(F.array(row("want", "missing"), row("got", "unexpected")), lambda r: r.key != "")
    )
    return both.select("doc_id", F.lit("person").alias("etype"), F.explode(rows).alias("r")).select(
        "doc_id", "etype", "r.key", "r.status"
    )


def _counts() -> list[Column]:
    return [F.count_if(F.col("status") == s).alias(s) for s in ("matched", "missing", "unexpected")]


def _scored(df: DataFrame, digits: int = 6) -> DataFrame:
    m = F.col("matched")
    return df.select("*", *prf(m, m + F.col("unexpected"), m + F.col("missing"), digits))


def eval_by_type(detail: DataFrame, digits: int = 6) -> DataFrame:
    """Counts and scores per document and type, per document, and overall (ROLLUP)."""
    out = detail.rollup("doc_id", "etype").agg(*_counts(), F.grouping_id().cast("int").alias("level"))
    return _scored(out, digits)


def eval_totals(detail: DataFrame, digits: int = 6) -> DataFrame:
    return _scored(detail.groupBy("doc_id").agg(*_counts()), digits)


def eval_micro(detail: DataFrame, digits: int = 6) -> DataFrame:
    """Micro-average over documents, per type and over all types (null type)."""
    return _scored(detail.rollup("etype").agg(*_counts()), digits)


def ranked_errors(detail: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` missing and the ``top`` unexpected entities by number of documents."""
    counts = detail.filter("status <> 'matched'").groupBy("status", "etype", "key").agg(F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.partitionBy("status").orderBy(F.desc("n_docs"), "etype", "key"))
    return counts.withColumn("rk", rank).filter(F.col("rk") <= top)


def has_discrepancies(detail: DataFrame) -> DataFrame:
    return detail.agg(F.coalesce(F.max(F.col("status") != "matched"), F.lit(False)).alias("has_discrepancies"))


def select_gold(manifest: DataFrame, gold: DataFrame, extracted: DataFrame, mode: str = "raw") -> DataFrame:
    """Which gold record each manifest entry is scored with, or why it is skipped.

    manifest: id, has_normalized_expected; gold: id, variant ('raw'|'normalized');
    extracted: id.
    """
    if mode not in ("raw", "normalized"):
        raise ValueError(f"mode must be raw or normalized, got {mode!r}")
    g = gold.filter(F.col("variant") == mode).select("id", F.lit(True).alias("has_gold"))
    e = extracted.select("id", F.lit(True).alias("has_extracted"))
    reason = (
        F.when((F.lit(mode) == "normalized") & ~F.coalesce("has_normalized_expected", F.lit(False)), "no normalized gold file (raw-only fixture)")
        .when(F.col("has_gold").isNull(), F.concat(F.lit("missing gold file: "), "id"))
        .when(F.col("has_extracted").isNull(), F.concat(F.lit("missing extraction output: "), "id"))
    )
    return manifest.join(g, "id", "left").join(e, "id", "left").select("id", F.lit(mode).alias("mode"), reason.alias("skipped"))


def threshold_check(extracted: DataFrame, gold: DataFrame, counts: DataFrame) -> DataFrame:
    """Quality floors per document; an empty side scores 1.

    extracted, gold: doc_id, etype, key with plain lower-case keys.
    counts: doc_id, n_skills, skills_min, skills_max, got_name, want_name.
    """
    d = eval_detail(extracted, gold).groupBy("doc_id").agg(
        *[
            F.count_if((F.col("etype") == t) & (F.col("status") == s)).alias(f"{t}_{s}")
            for t in ("skills", "jobs", "organizations")
            for s in ("matched", "missing", "unexpected")
        ]
    )
    recall = lambda t: ratio(F.col(f"{t}_matched"), F.col(f"{t}_matched") + F.col(f"{t}_missing"), 1.0)
    precision = ratio(F.col("skills_matched"), F.col("skills_matched") + F.col("skills_unexpected"), 1.0)
    got, want = F.lower("got_name"), F.lower("want_name")
    return counts.join(d, "doc_id", "left").na.fill(0).select(
        "doc_id",
        (recall("skills") >= SKILL_RECALL_MIN).alias("skill_recall_ok"),
        (precision >= SKILL_PRECISION_MIN).alias("skill_precision_ok"),
        (recall("jobs") >= JOB_RECALL_MIN).alias("job_recall_ok"),
        (recall("organizations") >= ORG_RECALL_MIN).alias("organization_recall_ok"),
        F.col("n_skills").between(F.col("skills_min"), F.col("skills_max")).alias("skill_count_ok"),
        (F.contains(got, want) | F.contains(want, got)).alias("name_ok"),
    )


def lint_gold(manifest: DataFrame, gold: DataFrame, normalized: DataFrame | None = None) -> DataFrame:
    """Breaches of annotation discipline, one row each: doc_id, rule, detail.

    manifest: doc_id, absent_types, present_types, excluded (etype, text array of
    structs); gold and normalized: eval_keys frames.
    """
    keys = gold.select("doc_id", "etype", "key")
    have = keys.select("doc_id", "etype").distinct()
    absent = manifest.select("doc_id", F.explode("absent_types").alias("etype"))
    present = manifest.select("doc_id", F.explode("present_types").alias("etype"))
    row = lambda df, rule, detail: df.select("doc_id", F.lit(rule).alias("rule"), detail.alias("detail"))
    items = manifest.select("doc_id", F.explode("excluded").alias("x")).select(
        "doc_id", F.col("x.etype").alias("etype"), F.col("x.text").alias("text"),
        *[F.lit(None).cast("string").alias(c) for c in ("label", "name", "title", "degree_type", "field_of_study")],
    )
    excluded = items.select("doc_id", "etype", eval_key().alias("key"))
    twice = manifest.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    out = (
        row(absent.join(have, ["doc_id", "etype"], "left_semi"), "absent_type_in_gold", F.col("etype"))
        .unionByName(row(absent.intersect(present), "absent_and_present", F.col("etype")))
        .unionByName(row(present.join(have, ["doc_id", "etype"], "left_anti"), "present_type_empty", F.col("etype")))
        .unionByName(row(excluded.join(keys, ["doc_id", "etype", "key"], "left_semi"), "excluded_in_gold", F.col("key")))
        .unionByName(row(twice, "duplicate_id", F.col("n").cast("string")))
    )
    if normalized is not None:
        other = lambda df: df.filter("etype <> 'skills'").select("doc_id", "etype", "key")
        both = normalized.select("doc_id").distinct()
        a, b = other(gold.join(both, "doc_id", "left_semi")), other(normalized)
        diff = a.exceptAll(b).unionByName(b.exceptAll(a)).distinct()
        out = out.unionByName(row(diff, "normalized_differs", F.concat("etype", F.lit(":"), "key")))
    return out


def scan_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text matches a secret pattern or carries a foreign e-mail domain."""
    flags = secret_flags(text)
    foreign = F.array_distinct(F.filter(email_domains(text), lambda d: ~d.isin(*SYNTHETIC_DOMAINS)))
    hits = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))
    rows = df.withColumn("finding", F.explode(F.concat(
        F.transform(hits, lambda h: F.struct(F.lit("secret").alias("kind"), h.alias("what"))),
        F.transform(foreign, lambda d: F.struct(F.lit("email_domain").alias("kind"), d.alias("what"))),
    )))
    return rows.drop(text).select("*", "finding.kind", "finding.what").drop("finding")


# ---------------------------------------------------------------- reports

def _pad(c: Column, width: int) -> Column:
    """Left-align in ``width`` without cutting longer text."""
    return F.when(F.length(c) < width, F.rpad(c, width, " ")).otherwise(c)


def _line(name: Column, width: int) -> Column:
    num = lambda c: F.format_string("%6.2f", F.bround(F.col(c), 2))
    i = lambda c: F.col(c).cast("string")
    return F.concat(
        _pad(name, width), F.lit(" "), num("precision"), F.lit(" "), num("recall"), F.lit(" "), num("f1"),
        F.lit("   "), i("matched"), F.lit(" / "), i("missing"), F.lit(" / "), i("unexpected"),
    )


def render_eval_report(detail: DataFrame) -> DataFrame:
    """The fixed-width report of every document: doc_id, report."""
    table = eval_by_type(detail, 3).filter("level < 2 and doc_id is not null")
    order = F.array_position(F.array(*[F.lit(t) for t in REPORT_TYPES]), F.col("etype")).cast("int")
    head = f"{'type':<15} {'P':>6} {'R':>6} {'F1':>6}   matched / missing / unexpected"
    rule = F.lit("-" * 72)
    body = table.select(
        "doc_id",
        F.when(F.col("level") == 0, order).otherwise(90).alias("sec"),
        F.when(F.col("level") == 0, F.array(_line(F.col("etype"), 15)))
        .otherwise(F.array(rule, _line(F.lit("TOTAL"), 15)))
        .alias("lines"),
    )
    listed = (
        detail.filter("status <> 'matched'")
        .groupBy("doc_id", "etype", "status")
        .agg(F.array_sort(F.collect_list("key")).alias("keys"))
        .select(
            "doc_id",
            (F.lit(100) + order * 2 + F.when(F.col("status") == "missing", 0).otherwise(1)).alias("sec"),
            F.array(F.concat(F.lit("  "), "status", F.lit(" "), "etype", F.lit(": "), F.array_join("keys", ", "))).alias("lines"),
        )
    )
    parts = body.unionByName(listed).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sec", "lines"))).alias("p"))
    lines = F.concat(F.array(F.lit(head), rule), F.flatten(F.transform("p", lambda x: x.lines)))
    return parts.select("doc_id", F.array_join(lines, "\n").alias("report"))


def render_batch_lines(detail: DataFrame, top: int = 10) -> DataFrame:
    """The batch report as ordered lines (sec, ord, line); documents are never collected."""
    head = "{:<%d} {:>6} {:>6} {:>6}   matched / missing / unexpected"
    docs = eval_totals(detail, 3)
    micro = eval_micro(detail, 3)
    order = F.array_position(F.array(*[F.lit(t) for t in REPORT_TYPES]), F.col("etype")).cast("int")
    n = detail.agg(F.count_distinct("doc_id").cast("string").alias("n"))
    line = lambda df, sec, ordc, text: df.select(F.lit(sec).alias("sec"), ordc.cast("string").alias("ord"), text.alias("line"))
    spark = detail.sparkSession
    fixed = spark.createDataFrame(
        [
            (1, "", (head % 20).format("document", "P", "R", "F1")),
            (1, "1", "-" * 78),
            (3, "", "Aggregate by entity type (micro-averaged over documents):"),
            (3, "1", (head % 15).format("type", "P", "R", "F1")),
            (3, "2", "-" * 78),
            (5, "", "-" * 78),
            (7, "", f"Most common missing entities (top {top}):"),
            (9, "", f"Most common unexpected entities (top {top}):"),
        ],
        "sec int, ord string, line string",
    )
    errors = ranked_errors(detail, top)
    item = F.concat(F.lit("  "), "key", F.lit(" ("), "etype", F.lit(") — "), F.col("n_docs").cast("string"), F.lit(" documents"))
    rk = digits_first(F.col("rk"))
    return (
        fixed.unionByName(line(n, 0, F.lit(""), F.concat(F.lit("Batch evaluation — "), "n", F.lit(" documents evaluated"))))
        .unionByName(line(docs, 2, F.col("doc_id").cast("string"), _line(F.col("doc_id").cast("string"), 20)))
        .unionByName(line(micro.filter("etype is not null"), 4, order, _line(F.col("etype"), 15)))
        .unionByName(line(micro.filter("etype is null"), 6, F.lit(""), _line(F.lit("TOTAL"), 15)))
        .unionByName(line(errors.filter("status = 'missing'"), 8, rk, item))
        .unionByName(line(errors.filter("status = 'unexpected'"), 10, rk, item))
    )


def test_run_summary(cases: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pass, fail and skip counts and the pass rate in percent."""
    n = lambda s: F.count_if(F.col("status") == s)
    return cases.groupBy(*keys).agg(
        F.count("*").alias("total"), n("PASS").alias("passed"), n("FAIL").alias("failed"), n("SKIP").alias("skipped"),
        F.bround(F.when(F.count("*") > 0, n("PASS") / F.count("*") * 100).otherwise(F.lit(0.0)), 6).alias("pass_rate"),
    )


def provider_comparison(metrics: DataFrame) -> DataFrame:
    """Time, entities, confidence and accuracy per provider record."""
    total = F.aggregate(F.map_values("entities_extracted"), F.lit(0).cast("long"), lambda a, x: a + x)
    at = lambda k: F.coalesce(F.try_element_at("entities_extracted", F.lit(k)), F.lit(0).cast("long"))
    return metrics.select(
        "provider", F.bround("extraction_time_sec", 1).alias("extraction_time_sec"), total.alias("total_entities"),
        at("jobs").alias("jobs"), at("skills").alias("skills"),
        F.bround("avg_confidence", 2).alias("avg_confidence"), "accuracy_percent",
    )


def acceptance(triples: DataFrame, unknown: DataFrame, expected_skills: DataFrame) -> DataFrame:
    """Graph-level acceptance per session: no untyped node, one person, skills deduplicated.

    expected_skills: session_id, label (raw declarations).
    """
    from careerloom import vocab as V
    from careerloom.operators.common import KEY

    kinds = triples.filter(F.col("p") == V.RDF_TYPE).groupBy(KEY).agg(
        F.count_if(F.col("o") == V.TYPE_IRI["person"]).alias("persons"),
        F.count_if(F.col("o") == V.TYPE_IRI["skill"]).alias("skills"),
    )
    want = expected_skills.groupBy(KEY).agg(F.count_distinct(case_key("label")).alias("distinct_skills"))
    bad = unknown.groupBy(KEY).agg(F.count("*").alias("unknown_nodes"))
    zero = F.lit(0).cast("long")
    return (
        kinds.join(want, KEY, "left")
        .join(bad, KEY, "left")
        .select(
            KEY,
            F.coalesce("unknown_nodes", zero).alias("unknown_nodes"),
            "persons", "skills", F.coalesce("distinct_skills", zero).alias("distinct_skills"),
        )
        .select(
            "*",
            (F.col("unknown_nodes") == 0).alias("no_unknown_nodes"),
            (F.col("persons") == 1).alias("single_person"),
            (F.col("skills") == F.col("distinct_skills")).alias("skills_deduplicated"),
        )
    )
