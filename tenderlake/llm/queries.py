"""The registered queries of this subpackage and their results in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tenderlake.llm import (
    archives,
    chat,
    decontam,
    divergence,
    exactdup,
    licenses,
    mixing,
    neardup,
    negatives,
    quality,
    sharding,
    toxicity,
    urls,
)

# The rules of the URL query.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).select("doc_id", "n_passages", "license", "dice")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversations(_table(spark, sf_dir, "conversations"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return neardup.near_duplicates(docs, shingle_words=3, percent=85).select(
        "doc_id", "n_shingles", "component_id", "kept"
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the ids stand as the snapshot, the others come in as a batch; both are returned."""
    docs = _table(spark, sf_dir, "documents")
    first = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, F.lit(True))
    return exactdup.exact_duplicates([docs.where(first)], docs.where(~first)).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_table(spark, sf_dir, "documents"), shards=40)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.verdicts(_table(spark, sf_dir, "pages"), URL_RULES)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id is divisible by 7 take the next of ten labels; those divisible by 100 are the anchors."""
    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


def op12_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archived(_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_license_scan": op2_license_scan,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_sharding": op7_sharding,
    "op8_url_filters": op8_url_filters,
    "op9_mixing": op9_mixing,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_warc_archives": op12_warc_archives,
    "op13_source_divergence": op13_source_divergence,
    "pipeline": pipeline,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _license_sql() -> str:
    names = ", ".join("({!r}, '{}')".format(n, t.replace("'", "''")) for n, t in licenses.TEMPLATES.items())
    words = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))"
    return rf"""
WITH template AS (
  SELECT name, {grams} AS g FROM (SELECT name, {words.format("t")} AS w FROM (VALUES {names}) AS x(name, t))
), passage AS (
  SELECT DISTINCT doc_id, p FROM documents, unnest(list_concat(
    string_split(coalesce(text, ''), chr(10)), [coalesce(text, '')],
    list_filter(string_split_regex(coalesce(text, ''), '\n[ \t\r]*\n'), lambda x: contains(trim(x), chr(10)))
  )) AS t(p)
), grams AS (
  SELECT doc_id, p, {grams} AS g FROM (SELECT doc_id, p, {words.format("p")} AS w FROM passage)
), near AS (
  SELECT doc_id, p, name, 2.0 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)) AS dice
  FROM grams AS a JOIN template AS b
    ON len(a.g) BETWEEN len(b.g) * {licenses.LEAST_DICE} / (2 - {licenses.LEAST_DICE})
                    AND len(b.g) * (2 - {licenses.LEAST_DICE}) / {licenses.LEAST_DICE}
), best AS (
  SELECT doc_id, count(DISTINCT p) AS n, arg_min(name, (-dice, name)) AS license, max(dice) AS dice
  FROM near WHERE dice >= {licenses.LEAST_DICE} GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_passages, license, CAST(dice AS DOUBLE) AS dice
FROM documents AS d LEFT JOIN best USING (doc_id)
"""


SQL: dict[str, str] = {
    "op2_license_scan": _license_sql(),
    "op4_minhash_near_dedup": rf"""
WITH RECURSIVE doc_words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 2], ' ') AS s
  FROM doc_words, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS t(k)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM shingles AS a JOIN shingles AS b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes AS p ON p.doc_id = x JOIN sizes AS q ON q.doc_id = y
  WHERE 100 * common >= 85 * (p.n + q.n - common)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM reach AS r JOIN links AS l ON l.x = r.y
)
SELECT r.x AS doc_id, coalesce(max(n), 0) AS n_shingles, min(r.y) AS component_id, r.x = min(r.y) AS kept
FROM reach AS r LEFT JOIN sizes AS s ON s.doc_id = r.x GROUP BY r.x
""",
    "op6_exact_dedup": r"""
WITH plain AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS rest
  FROM documents
), ranked AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY rest ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY rest) AS group_size
  FROM plain
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(rest) AS text_sha256 FROM ranked
""",
    "op10_benchmark_decontamination": rf"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, w[k : k + least(10, len(w)) - 1] AS win
  FROM item_words, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(k) WHERE len(w) > 0
), doc_words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), places AS (
  SELECT doc_id, s.n, k, w[k : k + s.n - 1] AS win
  FROM doc_words, (SELECT DISTINCT n FROM windows) AS s, unnest(range(1, len(w) - s.n + 2)) AS t(k)
), found AS (
  SELECT p.doc_id, p.k, p.n, v.item_id FROM places AS p JOIN windows AS v ON v.n = p.n AND v.win = p.win
), hits AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM found, unnest(range(k, k + n)) AS t(place) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc_words AS d LEFT JOIN hits AS h USING (doc_id) LEFT JOIN items AS i USING (doc_id)
""",
    "op11_hard_negatives": """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM whole AS a, whole AS b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
""",
    "op12_warc_archives": """
WITH payload AS (
  SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS size FROM pages
), firsts AS (
  SELECT *, CASE WHEN size >= 100 THEN min(page_id) OVER (PARTITION BY body) END AS first FROM payload
)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM firsts
""",
    "op13_source_divergence": r"""
WITH words AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), each AS (
  SELECT lang, source, doc, unnest(w) AS term FROM words
), kept AS (
  SELECT lang, term FROM each GROUP BY lang, term HAVING count(DISTINCT doc) >= 3
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM each JOIN kept USING (lang, term) GROUP BY ALL
), sizes AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), groups AS (
  SELECT lang, source, coalesce(sum(n), 0) + coalesce(any_value(v), 0) AS m
  FROM (SELECT DISTINCT lang, source FROM words) LEFT JOIN sizes USING (lang) LEFT JOIN counts USING (lang, source)
  GROUP BY lang, source
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
         1 + (1000000000 * CAST(coalesce(n, 0) + 1 AS HUGEINT)) // CAST(m AS HUGEINT) AS p
  FROM groups AS g JOIN kept AS k ON k.lang = g.lang
  LEFT JOIN counts AS c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), whole AS (
  SELECT lang, term, 1 + (1000000000 * CAST(sum(n) + 1 AS HUGEINT)) // CAST(
           (SELECT sum(n) FROM counts AS c WHERE c.lang = s.lang) + (SELECT v FROM sizes AS z WHERE z.lang = s.lang) AS HUGEINT) AS q
  FROM shares AS s GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         coalesce(sum((s.p - o.p) * (s.p - o.p) // o.p), 0) AS value
  FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares AS s ON s.lang = a.lang AND s.source = a.source
  LEFT JOIN shares AS o ON o.lang = a.lang AND o.source = b.source AND o.term = s.term
  GROUP BY ALL
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value
  FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
         CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (FROM pairs UNION ALL FROM terms)
)
FROM ranked WHERE part = 'pair' OR rank <= 200
""",
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
