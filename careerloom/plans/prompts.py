"""Prompt tables and the audit of generated texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careerloom.functions import bracket_citations, recover_json, strip
from careerloom.operators.common import KEY
from careerloom.operators.sessions import ANALYSIS_TYPES
from careerloom.plans import texts as TX
from careerloom.plans.texts import INSIGHTS
from careerloom.schemas import ALIAS_REPLY, ENTITY_RECORD

# Our own default instructions; callers may pass theirs.
SYNTHESIS_TEMPLATES = {
    "conservative": (
        "Write a career narrative from the analyses below. Say only what they show, cite each one you use by its "
        "name in [brackets], and give no advice.\n\n{analyses}"
    ),
    "exploratory": (
        "Write a career narrative from the analyses below. You may infer and suggest, but mark what is inference "
        "and cite the analyses it rests on by name in [brackets].\n\n{analyses}"
    ),
}
ALIAS_TEMPLATE = (
    "Group the {what} below that name the same thing. Merge only what is certain; a [declared skill] is the better "
    'name. Reply with JSON only: {{"groups": [{{"canonical": "", "members": [], "reasoning": ""}}]}}\n\n{items}'
)
EXTRACTION_TEMPLATE = (
    "Extract person, jobs, skills, education, certifications and organizations from the resume as one JSON object; "
    "give every organization an id of the form org-name and use it in jobs and education.\n\nResume text:\n---\n"
    "{text}\n---\n\nReply with JSON only."
)
POOL_NAMES = {
    "skill": "skill and technology labels",
    "org": "organization names",
    "degree": "academic degrees or fields of study",
}


def _place(template: str, field: str, value: Column) -> Column:
    before, _, after = template.partition("{" + field + "}")
    return F.concat(F.lit(before), value, F.lit(after))


def strip_front_matter(c: Column | str) -> Column:
    """Text after the second ``---``, or all of it where there is no front matter."""
    c = F.col(c) if isinstance(c, str) else c
    body = F.regexp_extract(c, r"(?s)^.*?---.*?---(.*)$", 1)
    return strip(F.when(c.rlike(r"(?s)---.*---"), body).otherwise(c))


def format_analyses(documents: DataFrame) -> DataFrame:
    """(session_id, analyses): a person's documents under named delimiters, in fixed order.

    documents: session_id, analysis_type, markdown — at most one row per type.
    """
    order = F.array_position(F.array(*[F.lit(t) for t in ANALYSIS_TYPES]), F.col("analysis_type"))
    section = F.concat(F.lit("═══ ["), "analysis_type", F.lit("] ═══\n"), strip_front_matter("markdown"))
    return (
        documents.groupBy(KEY)
        .agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), section.alias("t")))).alias("x"))
        .select(KEY, F.array_join(F.transform("x", lambda r: r.t), "\n\n").alias("analyses"))
    )


def synthesis_prompts(documents: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One prompt per person and variant: session_id, variant, prompt."""
    t = templates or SYNTHESIS_TEMPLATES
    variants = F.array(
        *[F.struct(F.lit(k).alias("variant"), _place(v, "analyses", F.col("analyses")).alias("prompt")) for k, v in t.items()]
    )
    return format_analyses(documents).select(KEY, F.explode(variants).alias("v")).select(KEY, "v.*")


def person_name_of(markdown: Column | str) -> Column:
    c = F.col(markdown) if isinstance(markdown, str) else markdown
    raw = F.regexp_extract(c, r"(?m)^[ \t]*person_name:(.*)$", 1)
    name = F.btrim(strip(raw), F.lit('"'))
    return F.when(~name.isin("", "None"), name)


def person_name_fallback(documents: DataFrame) -> DataFrame:
    """The person named in the first document that names one, else 'the candidate'."""
    order = F.array_position(F.array(*[F.lit(t) for t in ANALYSIS_TYPES]), F.col("analysis_type"))
    name = person_name_of("markdown")
    return documents.groupBy(KEY).agg(
        F.coalesce(F.min_by(name, F.when(name.isNotNull(), order)), F.lit("the candidate")).alias("person_name")
    )


def narrative_documents(replies: DataFrame, documents: DataFrame, provider: str, model: str, generated_at: Column) -> DataFrame:
    """(session_id, variant, filename, markdown): front matter and text of every reply to a synthesis prompt.

    replies: session_id, variant, response; documents: session_id, analysis_type, markdown, those that the prompts were
    made of. A reply that is null or blank makes no document.
    """
    order = F.array_position(F.array(*[F.lit(t) for t in ANALYSIS_TYPES]), F.col("analysis_type"))
    made_of = documents.groupBy(KEY).agg(F.array_sort(F.collect_set(F.struct(order.alias("o"), "analysis_type"))).alias("made_of"))
    names = person_name_fallback(documents)
    bullets = lambda items: F.transform(items, lambda x: F.concat(F.lit('  - "'), x, F.lit('"')))
    fixed = lambda items: bullets(F.array(*[F.lit(x) for x in items]))
    kv = lambda k, v: F.concat(F.lit(f"{k}: "), v)
    lines = F.concat(
        F.array(
            F.lit("---"), F.lit("analysis_type: career_narrative"), kv("variant", F.col("variant")), F.lit("synthesis: true"),
            F.concat(F.lit('title: "Career Narrative — '), F.initcap("variant"), F.lit(' Synthesis"')),
            kv("person_name", F.col("person_name")), kv("generated_at", F.date_format(generated_at, "yyyy-MM-dd'T'HH:mm:ss")),
            F.lit(f"provider: {provider}"), F.lit(f"model: {model}"), F.lit("source_analyses:"),
        ),
        bullets(F.transform("made_of", lambda x: x.analysis_type)),
        F.array(F.lit("tags:")), fixed(TX.NARRATIVE_TAGS), F.array(F.lit("query_hints:")), fixed(TX.NARRATIVE_HINTS),
        F.array(F.lit("---"), F.lit(""), F.col("response"), F.lit("")),
    )
    told = replies.filter(F.coalesce(strip("response"), F.lit("")) != "").select(KEY, "variant", "response")
    return told.join(made_of, KEY).join(names, KEY).select(
        KEY, "variant", F.concat(F.lit("career_narrative_"), "variant", F.lit(".md")).alias("filename"), F.array_join(lines, "\n").alias("markdown")
    )


def citation_audit(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Cited names per text with counts, and whether each names an analysis.

    ``[a + b]`` cites both.
    """
    span = F.explode(bracket_citations(text)).alias("span")
    inner = F.split(F.substr("span", F.lit(2)), r" \+ ")
    names = texts.select(key, span).select(key, F.explode(inner).alias("name"))
    name = strip(F.replace("name", F.lit("]"), F.lit("")))
    return (
        names.select(key, name.alias("name"))
        .groupBy(key, "name")
        .agg(F.count("*").alias("n"))
        .withColumn("known", F.col("name").isin(*INSIGHTS))
    )


def normalization_prompts(labels: DataFrame, template: str = ALIAS_TEMPLATE) -> DataFrame:
    """One alias prompt per session and pool, labels marked and in order."""
    mark = F.when(F.col("pool") != "skill", F.lit("")).when(F.col("declared"), F.lit(" [declared skill]")).otherwise(F.lit(" [used in job]"))
    item = F.concat(F.lit('  - "'), "label", F.lit('"'), mark)
    rank = F.when(F.col("declared") | (F.col("pool") != "skill"), 0).otherwise(1)
    packed = labels.groupBy(KEY, "pool").agg(
        F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.col("label").alias("l"), item.alias("i")))).alias("x")
    )
    what = F.coalesce(*[F.when(F.col("pool") == k, F.lit(v)) for k, v in POOL_NAMES.items()], F.lit("labels"))
    items = F.array_join(F.transform("x", lambda r: r.i), "\n")
    filled = template.replace("{{", "\0").replace("}}", "\1")
    head, _, rest = filled.partition("{what}")
    mid, _, tail = rest.partition("{items}")
    plain = lambda s: s.replace("\0", "{").replace("\1", "}")
    prompt = F.concat(F.lit(plain(head)), what, F.lit(plain(mid)), items, F.lit(plain(tail)))
    return packed.select(KEY, "pool", prompt.alias("prompt"))


def extraction_prompts(documents: DataFrame, text: str = "text", template: str = EXTRACTION_TEMPLATE) -> DataFrame:
    rest = [c for c in documents.columns if c != text]
    return documents.select(*rest, _place(template, "text", F.col(text)).alias("prompt"))


def generate(prompts: DataFrame, backend: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """Add ``response`` by calling ``backend`` on Arrow batches of prompts.

    Without a backend every response is null, the no-op generator.
    """
    if backend is None:
        return prompts.withColumn("response", F.lit(None).cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(response=backend(pdf["prompt"]))

    schema = T.StructType([*prompts.schema.fields, T.StructField("response", T.StringType())])
    return prompts.mapInPandas(run, schema)


def parse_responses(responses: DataFrame) -> DataFrame:
    """Responses as entity records with status complete, empty or error."""
    from careerloom.operators.assemble import empty_extraction_flag

    parsed = responses.withColumn("r", recover_json("response", ENTITY_RECORD))
    names = [f.name for f in ENTITY_RECORD.fields if f.name != "_corrupt_record"]
    flat = parsed.select(*responses.columns, F.col("r").isNull().alias("_bad"), *[F.col(f"r.{n}").alias(n) for n in names])
    status = F.when(F.col("_bad"), "error").when(empty_extraction_flag(), "empty").otherwise("complete")
    return flat.withColumn("status", status).drop("_bad")


def parse_alias_replies(responses: DataFrame) -> DataFrame:
    """Alias groups of each reply; an unreadable reply has none."""
    parsed = responses.select(KEY, "pool", recover_json("response", ALIAS_REPLY).alias("r"))
    return parsed.select(KEY, "pool", F.inline("r.groups")).select(KEY, "pool", "canonical", "members", "reasoning")
