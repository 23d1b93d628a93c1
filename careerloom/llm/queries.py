"""The registered queries of the corpus operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careerloom.llm import bpe, ctw, digests, divergence, lattice, mixing, passages, quality, simhash, topk, toxicity, variants, wordpiece
from careerloom.llm.common import bucket
from careerloom.runtime import buckets_for

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_byte_level_bpe")
def byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op6_simhash_gray_index")
def simhash_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def _judged(spark: SparkSession, sf_dir: str, method, modulus: int, kept_out: int, threshold: float) -> DataFrame:
    """Fits on labelled rows outside one remainder, scores every row."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(bucket("doc_id", modulus) == kept_out, F.lit(False))
    model = method.fit(docs, labels.filter(~held_out))
    return method.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


@query("op4_char_ngram_toxicity")
def char_ngram_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir, toxicity, 3, 1, 0.7)


@query("op9_word_ngram_quality")
def word_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir, quality, 5, 0, 0.3)


@query(
    "op10_tiled_top_k",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
      FROM embeddings
      WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
    ), r AS (
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
    )
    SELECT * FROM r WHERE rank <= 10
    """,
)
def tiled_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"))


@query("op5_block_mix")
def block_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op3_longest_match_counts")
def longest_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query(
    "op8_e8_lattice",
    """
    WITH RECURSIVE v AS (
      SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), link AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.95
    ), walk AS (
      SELECT vec_id AS a, vec_id AS b FROM embeddings
      UNION SELECT w.a, l.b FROM walk w JOIN link l ON l.a = w.b
    )
    SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links,
      (SELECT min(b) FROM walk WHERE a = vec_id) AS component_id,
      (SELECT min(b) FROM walk WHERE a = vec_id) = vec_id AS kept
    FROM embeddings
    """,
)
def e8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op7_paragraph_minhash")
def paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents")).drop("text_hash")


@query("op2_context_tree_weighting")
def context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(bucket("doc_id", 7) == 2, F.lit(False))
    return ctw.score(table(spark, sf_dir, "documents"), ~held_out).withColumn("held_out", ~F.col("train")).drop("train")


@query(
    "op11_digest_index",
    """
    WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
)
def digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digests.exact_duplicates(docs, digests.DigestIndex.scratch(spark, buckets_for(docs)))


@query(
    "op12_dominance_skyband",
    r"""
    WITH d AS (
      SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
    ), w AS (
      SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
    ), t AS (
      SELECT lang, term, count(*) AS lang_c FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 30
    ), l AS (SELECT lang, count(*) AS v, sum(lang_c) AS lang_n FROM t GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN t USING (lang, term) GROUP BY lang, source, term),
    k AS (
      SELECT g.lang, g.source, t.term, t.lang_c, coalesce(c.c, 0) AS c, l.v, l.lang_n, coalesce(sum(c.c) OVER (PARTITION BY g.lang, g.source), 0) AS n
      FROM g JOIN t USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term
    ), p AS (
      SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 5)) // (n + 5 * v) AS p, 1 + (1000000000::HUGEINT * (lang_c + 5)) // (lang_n + 5 * v) AS q FROM k
    ), s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL),
    r AS (
      SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(s.value, 0) AS value
      FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
    """,
)
def dominance_skyband(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


@query(
    "op13_trie_node_pairs",
    """
    WITH RECURSIVE crc AS (
      SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
    ), runs AS (
      SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
      FROM documents
    ), r AS (
      SELECT run, count(*) AS n, hex(encode(concat(doc_id, ':', run))) AS x FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run
    ), h AS (
      SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2),
          lambda i: (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 1)),
        lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS h
      FROM r, crc
    ), m AS (
      SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM h
    ), w AS (
      SELECT word, CAST(sum(n) AS BIGINT) AS n FROM m WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
    ), v AS (
      SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)
    ), near AS (
      SELECT a.word, b.word AS other, b.n FROM v a JOIN v b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
      UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.less = w.word
      UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.less = w.word
    ), top AS (
      SELECT word, count(*) AS n_near, max(n) AS top_n, min(CASE WHEN n = most THEN other END) AS other
      FROM (SELECT word, other, n, max(n) OVER (PARTITION BY word) AS most FROM near) GROUP BY word
    ), f AS (
      SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 5 * w.n THEN other END AS form, CASE WHEN top_n >= 5 * w.n THEN top_n END AS form_n
      FROM w LEFT JOIN top USING (word)
    ), walk AS (
      SELECT word, word AS at FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NOT NULL
    ), root AS (SELECT walk.word, walk.at AS root FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NULL)
    SELECT word, form, root, n, n_near, form_n FROM f JOIN root USING (word)
    """,
)
def trie_node_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))
