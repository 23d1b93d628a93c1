"""Matching labels against a taxonomy table.

taxonomy: concept_uri, pref_label, broader_uri, broader_label, hierarchy_uri, hierarchy_label
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careerloom import vocab as V
from careerloom.functions import case_key, is_circular_broader, strip, taxonomy_key, taxonomy_match_score

from careerloom.runtime import broadcast_if_small


def _grams(c: Column) -> Column:
    """Distinct 3-grams, and the 2-grams that two-letter labels need."""
    cut = lambda w: F.when(
        F.length(c) >= w, F.transform(F.sequence(F.lit(1), F.length(c) - (w - 1)), lambda i: F.substr(c, i, F.lit(w)))
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(cut(3), cut(2)))


def _first_word(c: Column) -> Column:
    return F.split(strip(c), r"\s+").getItem(0)


def match_candidates(labels: DataFrame, taxonomy: DataFrame, limit: int | None = 5) -> DataFrame:
    """Scored concepts per label, the best ``limit`` of them (None for all).

    A hit shares the first word with the label or contains the label; a
    container holds every 3-gram of the label, so blocking on the label's rarest
    3-gram finds them all. The limit is the search service's page size.
    """
    lab = labels.select("label").distinct().withColumn("l", F.lower("label")).filter(F.length("l") >= 2)
    tax = taxonomy.select("concept_uri", "pref_label").withColumn("t", F.lower("pref_label"))
    width = F.least(F.length("l"), F.lit(3))
    tax_grams = tax.select("concept_uri", "pref_label", F.explode(_grams(F.col("t"))).alias("block"))
    rarity = tax_grams.groupBy("block").agg(F.count("*").alias("df"))
    own = lab.select(
        "label", "l",
        F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("l") - width + 1), lambda i: F.substr(F.col("l"), i, width)))).alias("block"),
    )
    # A gram the taxonomy lacks rules every container out, hence the left join.
    picked = (
        own.join(broadcast_if_small(rarity), "block", "left")
        .groupBy("label")
        .agg(F.min_by("block", F.struct(F.coalesce("df", F.lit(0)), F.col("block"))).alias("block"))
    )
    inside = picked.join(broadcast_if_small(tax_grams), "block").select("label", "concept_uri", "pref_label")
    first = lab.select("label", _first_word(F.col("l")).alias("w")).filter("w <> ''").join(
        tax.select("concept_uri", "pref_label", _first_word(F.col("t")).alias("w")), "w"
    )
    scored = (
        inside.unionByName(first.select("label", "concept_uri", "pref_label"))
        .distinct()
        .withColumn("score", taxonomy_match_score("label", "pref_label"))
        .filter("score > 0")
    )
    if limit is None:
        return scored
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "pref_label", "concept_uri"))
    return scored.withColumn("rk", rank).filter(F.col("rk") <= limit)


def best_match(candidates: DataFrame) -> DataFrame:
    """The first highest-scoring concept of each label."""
    row = F.struct("concept_uri", "pref_label", "score")
    return candidates.groupBy("label").agg(
        F.min_by(row, F.struct(-F.col("score"), F.col("pref_label"), F.col("concept_uri"))).alias("r")
    ).select("label", "r.concept_uri", F.col("r.pref_label").alias("preferred_label"), "r.score")


def broader_of(matches: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Direct broader concept, else the hierarchy concept; both null where there is none."""
    t = taxonomy.select(
        "concept_uri",
        F.coalesce("broader_uri", "hierarchy_uri").alias("broader_uri"),
        F.when(F.col("broader_uri").isNotNull(), F.col("broader_label")).otherwise(F.col("hierarchy_label")).alias("broader_label"),
    )
    return matches.join(broadcast_if_small(t), "concept_uri", "left")


def drop_circular(matches: DataFrame, limit: float = 0.6) -> DataFrame:
    """A broader label made of the label's own words says nothing; blank it."""
    circular = is_circular_broader("label", "broader_label", limit)
    keep = lambda c: F.when(~circular, F.col(c)).alias(c)
    return matches.select(*[keep(c) if c in ("broader_uri", "broader_label") else F.col(c) for c in matches.columns])


def lookup(labels: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """label_key with its match, misses included.

    Labels are reduced to distinct keys before any matching.
    """
    keys = labels.select(case_key("label").alias("label")).filter("label <> ''").distinct()
    hits = drop_circular(broader_of(best_match(match_candidates(keys, taxonomy, limit=None)), taxonomy))
    return keys.join(hits, "label", "left").select(
        F.col("label").alias("label_key"), "concept_uri", "preferred_label", "broader_uri", "broader_label"
    )


def lookup_incremental(labels: DataFrame, results: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Match only keys without a stored result (a stored miss counts as one)."""
    unseen = labels.select(case_key("label").alias("label_key")).distinct().join(results, "label_key", "left_anti")
    fresh = lookup(unseen.select(F.col("label_key").alias("label")), taxonomy)
    return results.unionByName(fresh)


def match_stats(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("total"),
        F.count("concept_uri").alias("matched"),
        F.count_if(F.col("concept_uri").isNull()).alias("unmatched"),
        F.count_distinct("broader_label").alias("concept_labels"),
    )


def category_table(spark) -> DataFrame:
    """The fixed category hierarchy: category_key, broader, narrower."""
    rows = [(k, [b] if b else [], list(n)) for k, (b, n) in V.SKILL_CATEGORIES.items()]
    return spark.createDataFrame(rows, "category_key string, cat_broader array<string>, cat_narrower array<string>")


def link_taxonomy(skills: DataFrame, uris: DataFrame, categories: DataFrame, inverse: bool = False) -> DataFrame:
    """Fill a missing taxonomy URI by label, and a missing hierarchy by category name.

    ``uris``: taxonomy_key, uri. ``inverse`` also gives a label listed as
    narrower of a category that category as its broader concept.
    """
    none = F.array().cast("array<string>")
    k = taxonomy_key("label")
    bare = (F.coalesce(F.array_size("broader_concepts"), F.lit(0)) == 0) & (
        F.coalesce(F.array_size("narrower_concepts"), F.lit(0)) == 0
    )
    if inverse:
        listed = categories.select(
            F.explode("cat_narrower").alias("category_key"), F.array("category_key").alias("up")
        ).join(categories.select("category_key").withColumn("own", F.lit(True)), "category_key", "left_anti")
        categories = categories.unionByName(
            listed.groupBy("category_key").agg(F.min("up").alias("cat_broader")).withColumn("cat_narrower", none)
        )
    out = (
        skills.withColumn("_k", k)
        .join(broadcast_if_small(uris.select(F.col("taxonomy_key").alias("_k"), F.col("uri").alias("_uri"))), "_k", "left")
        .join(broadcast_if_small(categories.withColumnRenamed("category_key", "_k")), "_k", "left")
    )
    fill = {
        "skos_uri": F.coalesce(F.nullif(F.col("skos_uri"), F.lit("")), F.col("_uri")),
        "broader_concepts": F.when(bare, F.coalesce("cat_broader", none)).otherwise(F.coalesce("broader_concepts", none)),
        "narrower_concepts": F.when(bare, F.coalesce("cat_narrower", none)).otherwise(F.coalesce("narrower_concepts", none)),
    }
    return out.select(*[fill[c].alias(c) if c in fill else F.col(c) for c in skills.columns])
