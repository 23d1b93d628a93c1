"""Insight documents as ordered lines, and their assembly into texts.

Every renderer returns lines (session_id, sec, a, b, seq, line). Lines sort by
(sec, a, b, seq) within a person, so they can be written and read without ever
holding a whole career in one row; ``assemble_text`` joins them where a
document is wanted as one string.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerloom.operators import analyze as A
from careerloom.operators.common import KEY, digits_first
from careerloom.plans import texts as TX

ORD = ["sec", "a", "b", "seq"]


def fill(template: str, **cols: Column | str) -> Column:
    """A template with {fields} as a concat of literals and columns."""
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        if re.fullmatch(r"\{\w+\}", piece):
            c = cols[piece[1:-1]]
            parts.append((F.col(c) if isinstance(c, str) else c).cast("string"))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def first_name(c: str = "person_name") -> Column:
    return F.regexp_extract(F.trim(c), r"^(\S+)", 1)


def lines(df: DataFrame, sec: int, *text: Column | str, a: Column | None = None, b: Column | None = None) -> DataFrame:
    """One output row per given text, in order; null texts are left out."""
    cells = [F.lit(t) if isinstance(t, str) else t for t in text]
    numbered = F.array(*[F.struct(F.lit(i).alias("seq"), c.alias("line")) for i, c in enumerate(cells)])
    return df.select(
        KEY, F.lit(sec).alias("sec"),
        (F.lit("") if a is None else a).alias("a"), (F.lit("") if b is None else b).alias("b"),
        F.explode(numbered).alias("x"),
    ).select(KEY, "sec", "a", "b", "x.seq", "x.line").filter("line is not null")


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _pack(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*ORD, "line"))).alias("x"))
    return packed.select(*keys, F.array_join(F.transform("x", lambda r: r.line), "\n").alias(name))


def assemble_text(rows: DataFrame, name: str = "content") -> DataFrame:
    """Join a person's lines into one text."""
    return _pack(rows, [KEY], name)


def _names(persons: DataFrame) -> DataFrame:
    return persons.select(KEY, first_name().alias("name"))


def _zero(c: str) -> Column:
    return F.coalesce(c, F.lit(0))


def _plural(n: str) -> Column:
    return F.concat(F.col(n).cast("string"), F.when(F.col(n) == 1, F.lit(" skill")).otherwise(F.lit(" skills")))


def _having(df: DataFrame, names: DataFrame) -> DataFrame:
    """The persons that occur in ``df``."""
    return names.join(df.select(KEY).distinct(), KEY)


def render_skill_gap(persons: DataFrame, jobs: DataFrame, skills: DataFrame, tech: DataFrame) -> DataFrame:
    names, claims = _names(persons), A.claimed_skills(skills, tech)
    both = F.when(F.col("status") == "both", F.col("label"))
    of_claims = claims.groupBy(KEY).agg(
        F.count("*").alias("claimed_count"), F.count(both).alias("overlap_count"),
        F.nullif(F.array_join(F.array_sort(F.collect_list(both)), ", "), F.lit("")).alias("overlap"),
    )
    of_used = tech.groupBy(KEY).agg(F.count_distinct("tech_key").alias("used_count"))
    head = names.join(of_claims, KEY, "left").join(of_used, KEY, "left")
    text = fill(
        TX.GAP_HEAD, name="name", claimed=_zero("claimed_count"), used=_zero("used_count"), both=_zero("overlap_count"),
        overlap=F.coalesce("overlap", F.lit("none")),
    )
    roles = A.used_not_claimed(skills, tech, jobs.withColumn("title", F.coalesce("title", F.lit(""))))
    order = F.concat(F.when(F.col("start") == "?", "0000").otherwise(F.col("start")), F.lit("|"), "job_id")
    per_role = roles.groupBy(KEY, order.alias("a"), "title", "start", "end").agg(F.lit(1).alias("_"))
    claimed = claims.filter("status = 'claimed_only'")
    return union(
        lines(head, 0, text, ""),
        lines(_having(roles, names), 1, "## Undersold Capabilities", "", fill(TX.GAP_USED, name="name"), ""),
        lines(per_role, 2, fill("**{title} ({start}–{end})**", title="title", start="start", end="end"), a=F.col("a")),
        lines(roles, 2, F.concat(F.lit("- "), "label"), a=order, b=F.concat(F.lit("t"), "label")),
        lines(per_role, 2, "", a=F.col("a"), b=F.lit("~")),
        lines(_having(claimed, names), 3, "## Ungrounded Claims", "", TX.GAP_CLAIMED, ""),
        lines(
            claimed, 4,
            fill("- **{label}** — {cat}, {prof}", label="label", cat=F.coalesce("category", F.lit("?")), prof=F.coalesce("proficiency_level", F.lit("unrated"))),
            a=F.col("label"),
        ),
    )


def render_topology(persons: DataFrame, jobs: DataFrame, tech: DataFrame) -> DataFrame:
    names, spread = _names(persons), A.technology_spread(tech)
    n_jobs = jobs.groupBy(KEY).agg(F.count("*").alias("n_jobs"))
    is_bridge = F.col("role") == "bridge"
    sums = spread.groupBy(KEY).agg(
        F.count("*").alias("techs"),
        F.count_if(is_bridge).alias("bridges"),
        F.array_join(F.array_sort(F.collect_list(F.when(is_bridge, F.col("label")))), ", ").alias("names"),
    )
    head = names.join(n_jobs, KEY, "left").join(sums, KEY, "left")
    args = dict(name="name", jobs=_zero("n_jobs"), techs=_zero("techs"), bridges=_zero("bridges"), names=F.coalesce("names", F.lit("")))
    text = (
        F.when(_zero("bridges") == 0, fill(TX.TOPOLOGY_NONE, **args))
        .when(_zero("bridges") <= 2, fill(TX.TOPOLOGY_FEW, **args))
        .otherwise(fill(TX.TOPOLOGY_MANY, **args))
    )
    bridges = spread.filter(is_bridge)
    roles = (
        tech.join(bridges.select(KEY, "tech_key", F.col("label").alias("bridge")), [KEY, "tech_key"])
        .join(jobs.select(KEY, "job_id", "title", A.job_order().alias("ord")), [KEY, "job_id"])
        .groupBy(KEY, "bridge")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "title"))).alias("r"))
        .select(KEY, "bridge", F.array_join(F.transform("r", lambda x: x.title), " and ").alias("roles"))
    )
    lonely = A.isolated_roles(tech, jobs).join(jobs.select(KEY, "job_id", A.job_order().alias("ord")), [KEY, "job_id"])
    return union(
        lines(head, 0, text, ""),
        lines(_having(bridges, names), 1, "## Bridge Technologies", "", TX.TOPOLOGY_BRIDGES, ""),
        lines(roles, 2, fill("- **{tech}** — connects: {roles}", tech="bridge", roles="roles"), a=F.col("bridge")),
        lines(_having(bridges, names), 3, ""),
        lines(_having(lonely, names), 4, "## Isolated Roles", "", TX.TOPOLOGY_ISOLATED, ""),
        lines(lonely, 5, F.concat(F.lit("- "), "title"), a=F.col("ord")),
        lines(_having(lonely, names), 6, "", fill(TX.TOPOLOGY_MEANING, name="name")),
    )


def _achievements(df: DataFrame, n: int | None) -> DataFrame:
    arr = F.coalesce("achievements", F.array().cast("array<string>"))
    return df.select(KEY, "ord", F.posexplode(F.slice(arr, 1, n) if n else arr).alias("i", "text"))


def render_evolution(persons: DataFrame, jobs: DataFrame, tech: DataFrame) -> DataFrame:
    names = _names(persons)
    tools = tech.groupBy(KEY, "job_id").agg(F.array_join(F.array_sort(F.collect_list("label")), ", ").alias("tools"))
    line = jobs.withColumn("ord", A.job_order()).join(tools, [KEY, "job_id"], "left")
    head = names.join(jobs.groupBy(KEY).agg(F.count("*").alias("n")), KEY, "left")
    title = fill(
        "### {title} ({start} – {end}){cur}", title=F.coalesce("title", F.lit("")), start=A.start_text(), end=A.end_text(),
        cur=F.when(F.col("is_current"), F.lit(TX.CURRENT)).otherwise(F.lit("")),
    )
    has = F.coalesce(F.array_size("achievements"), F.lit(0)) > 0
    steps = A.consecutive_jobs(jobs)
    moves = (
        A.tech_transitions(jobs, tech)
        .groupBy(KEY, "ord", "change")
        .agg(F.array_join(F.array_sort(F.collect_list("tech_key")), ", ").alias("keys"))
    )
    label = F.when(F.col("change") == "retained", "Retained").when(F.col("change") == "gained", "Gained").otherwise("Dropped")
    rank = F.when(F.col("change") == "retained", "1").when(F.col("change") == "gained", "2").otherwise("3")
    ach = _achievements(line, None)
    return union(
        lines(head, 0, fill(TX.EVOLUTION_HEAD, name="name", jobs=_zero("n")), "", "## Chronological Technology Timeline", ""),
        lines(line, 1, title, fill("**Tools:** {t}", t=F.coalesce("tools", F.lit(TX.NO_TOOLS))), F.when(has, F.lit("")), a=F.col("ord")),
        lines(ach, 1, F.concat(F.lit("- "), "text"), a=F.col("ord"), b=digits_first(F.col("i"))),
        lines(line, 1, "", a=F.col("ord"), b=F.lit("~")),
        lines(_having(steps, names), 2, "## Transition Analysis", ""),
        lines(steps, 3, fill("**{x} → {y}**", x="from_title", y="to_title"), a=F.col("ord")),
        lines(moves, 3, F.concat(F.lit("- *"), label, F.lit(":* "), "keys"), a=F.col("ord"), b=rank),
        lines(steps, 3, "", a=F.col("ord"), b=F.lit("~")),
    )


def render_hierarchy(persons: DataFrame, skills: DataFrame, matches: DataFrame) -> DataFrame:
    names = _names(persons)
    named = A.named_skills(skills)
    grouped = A.with_taxonomy_group(skills, matches)
    share = names.join(A.taxonomy_share(grouped), KEY, "left")
    text = fill(
        TX.HIERARCHY_HEAD, name="name", total=_zero("total"), matched=_zero("matched"), pct=_zero("pct"), unmatched=_zero("unmatched"),
    )
    links = (
        A.explicit_hierarchy(skills)
        .groupBy(KEY, "skill_id", "label", "direction")
        .agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    )
    hit, miss = grouped.filter("broader_label is not null"), grouped.filter("broader_label is null")
    groups = A.by_taxonomy_group(hit)
    cat = F.coalesce("category", F.lit(""))
    note = F.when((cat != "") & (F.lower(cat) != "uncategorized"), F.concat(F.lit(" *("), cat, F.lit(")*"))).otherwise(F.lit(""))
    cats = named.groupBy(KEY, A.category_of().alias("cat")).agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("label")), ", ").alias("labels")
    )
    direction = F.when(F.col("direction") == "includes", "1").otherwise("2")
    return union(
        lines(share, 0, text, ""),
        lines(_having(links, names), 1, "## Explicit SKOS Hierarchy", ""),
        lines(
            links, 2, fill("- **{label}** → {d}: {names}", label="label", d="direction", names="names"),
            a=F.concat("label", F.lit("|"), "skill_id"), b=direction,
        ),
        lines(_having(links, names), 3, ""),
        lines(_having(groups, names), 4, "## Skills by ESCO Category", "", TX.HIERARCHY_GROUPS, ""),
        lines(groups, 5, fill("**{g}** ({n})", g="group_label", n=_plural("n_skills")), "", a=F.col("group_label")),
        lines(hit, 5, F.concat(F.lit("- "), "label"), a=F.col("broader_label"), b=F.concat(F.lit("t"), "label", F.lit("|"), "skill_id")),
        lines(groups, 5, "", a=F.col("group_label"), b=F.lit("~")),
        lines(_having(miss, names), 6, "## Domain-Specific & Uncategorized Skills", "", TX.HIERARCHY_OTHER, ""),
        lines(miss, 7, F.concat(F.lit("- "), "label", note), a=F.concat("label", F.lit("|"), "skill_id")),
        lines(_having(miss, names), 8, ""),
        lines(_having(cats, names), 9, "## By Extraction Category", "", TX.HIERARCHY_CATEGORIES, ""),
        lines(cats, 10, fill("**{c}** ({n}): {labels}", c="cat", n=_plural("n"), labels="labels"), "", a=F.col("cat")),
    )


def render_coverage(persons: DataFrame, skills: DataFrame) -> DataFrame:
    names, named = _names(persons), A.named_skills(skills)
    head = names.join(A.taxonomy_coverage(skills), KEY, "left")
    text = fill(TX.COVERAGE_HEAD, pct=_zero("coverage_pct"), name="name", linked=_zero("linked"), total=_zero("total"))
    is_linked = F.coalesce(F.col("skos_uri") != "", F.lit(False))
    linked, free = named.filter(is_linked), named.filter(~is_linked)
    order = F.concat("label", F.lit("|"), "skill_id")
    return union(
        lines(head, 0, text, ""),
        lines(_having(linked, names), 1, "## Globally Identifiable Skills (ESCO-linked)", ""),
        lines(linked, 2, fill("- **{label}**", label="label"), a=order),
        lines(_having(linked, names), 3, ""),
        lines(_having(free, names), 4, "## String-Only Skills (not globally identifiable)", ""),
        lines(free, 5, fill("- {label} *({cat})*", label="label", cat=F.coalesce("category", F.lit("?"))), a=order),
        lines(_having(free, names), 6, "", fill(TX.COVERAGE_PATTERN, name="name")),
    )


def render_progression(persons: DataFrame, jobs: DataFrame) -> DataFrame:
    names = _names(persons)
    head = names.join(A.role_progression(jobs), KEY, "left")
    text = F.when(
        F.col("total_roles") > 0,
        fill(TX.PROGRESSION_HEAD, name="name", jobs="total_roles", first="first_start", titles="unique_titles"),
    ).otherwise(fill(TX.PROGRESSION_EMPTY, name="name"))
    line = jobs.withColumn("ord", A.job_order())
    title = fill(
        "### {title} ({start} – {end}){cur}", title=F.coalesce("title", F.lit("")), start=A.start_text(), end=A.end_text(),
        cur=F.when(F.col("is_current"), F.lit(TX.CURRENT)).otherwise(F.lit("")),
    )
    titles, orgs = A.repeated_titles(jobs), A.repeated_orgs(jobs)
    loyal = orgs.groupBy(KEY).agg(F.count("*").alias("n"))
    return union(
        lines(head, 0, text, "", "## Career Timeline", ""),
        lines(line, 1, title, a=F.col("ord")),
        lines(_achievements(line, 2), 1, F.concat(F.lit("- "), "text"), a=F.col("ord"), b=F.col("i").cast("string")),
        lines(line, 1, "", a=F.col("ord"), b=F.lit("~")),
        lines(_having(titles, names), 2, "## Recurring Titles", ""),
        lines(titles, 3, fill(TX.PROGRESSION_TITLE, title="title"), a=F.col("title")),
        lines(_having(titles, names), 4, ""),
        lines(loyal, 5, "## Organizational Loyalty", "", fill(TX.PROGRESSION_LOYALTY, orgs="n")),
    )
