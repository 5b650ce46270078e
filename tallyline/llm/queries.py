"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import (
    exact_dedup,
    filter_audit,
    hard_negatives,
    host_text,
    katz,
    licenses,
    mixing,
    ngram_join,
    packing,
    sharding,
    token_counts,
    toxicity,
    vector_graph,
)
from tallyline.llm.shipping import ship_package

SHARDS = [f"shard-{i:02d}" for i in range(64)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def licenses_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_documents(spark, sf_dir))


def vector_graph_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The audited recall says how the search went, not what it found.
    return vector_graph.near_duplicates(_table(spark, sf_dir, "embeddings")).drop("audited_recall")


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.plan_mix(_documents(spark, sf_dir)))


def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place_rows(_documents(spark, sf_dir), ["doc_id"], SHARDS)


def ngram_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_documents(spark, sf_dir))


def katz_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_texts(_documents(spark, sf_dir))


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), with_ids=False).drop("ids")


def exact_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_duplicates(_documents(spark, sf_dir))


def token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir))


def host_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_text.extract_text(_table(spark, sf_dir, "pages"))


def filter_audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def hard_negatives_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    id_ = F.col("vec_id")
    label = F.when(id_ % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(vectors.withColumn("label", label), id_ % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licenses": licenses_query,
        "op2_vector_graph": vector_graph_query,
        "op3_toxicity": toxicity_query,
        "op4_mixing": mixing_query,
        "op5_sharding": sharding_query,
        "op6_ngram_join": ngram_join_query,
        "op7_katz": katz_query,
        "op8_packing": packing_query,
        "op9_exact_dedup": exact_dedup_query,
        "op10_token_counts": token_counts_query,
        "op11_host_text": host_text_query,
        "op12_filter_audit": filter_audit_query,
        "op13_hard_negatives": hard_negatives_query,
    }


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _licenses_sql() -> str:
    phrases = ", ".join(
        f"({i}, '{t.phrase}', {len(t.phrase.split())}, '{t.label}', {str(t.base).lower()})"
        for i, t in enumerate(licenses.TEMPLATES)
    )
    return rf"""
WITH templates(template, phrase, n, label, base) AS (VALUES {phrases}),
texts AS (
    SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
),
starts AS (
    SELECT doc_id, words, unnest(range(len(words))) AS start FROM texts
),
places AS (
    SELECT doc_id, start, label, base
    FROM starts JOIN templates ON words[start + 1] = split_part(phrase, ' ', 1)
        AND array_to_string(words[start + 1 : start + n], ' ') = phrase
),
found AS (
    SELECT doc_id,
        count(*) FILTER (base) AS n_base,
        min(start) FILTER (base) AS first_word,
        max(start) FILTER (base) AS last_word,
        count(*) AS n_places,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
        string_agg(DISTINCT label, ',' ORDER BY label) AS labels
    FROM places GROUP BY doc_id
)
SELECT t.doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
    coalesce(n_places, 0) AS n_places, 1 - pow(2.0, -coalesce(n_places, 0)) AS score
FROM texts t LEFT JOIN found f ON f.doc_id = t.doc_id
"""


EXACT_DEDUP_SQL = f"""
WITH texts AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM texts WINDOW same AS (PARTITION BY text_sha256)
"""


# All pairs that share a shingle, and whatever is reached over links.
NGRAM_JOIN_SQL = rf"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
),
places AS (
    SELECT doc_id, words, least(5, len(words)) AS n, unnest(range(1, len(words) - least(5, len(words)) + 2)) AS place
    FROM texts WHERE len(words) > 0
),
shingles AS (SELECT DISTINCT doc_id, array_to_string(words[place : place + n - 1], ' ') AS shingle FROM places),
sizes AS (SELECT doc_id, count(*) AS size FROM shingles GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
),
links AS (
    SELECT a, b, shared = x.size AND shared = y.size AS same
    FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 10 * shared >= 8 * (x.size + y.size - shared)
),
reached AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION
    SELECT doc_id, b FROM reached JOIN links ON a = other
),
components AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT c.doc_id, coalesce(least(c.doc_id, min(b) FILTER (same)), c.doc_id) AS class_id, count(b) AS n_links, component_id
FROM components c LEFT JOIN links ON a = c.doc_id GROUP BY c.doc_id, component_id
"""


VECTOR_GRAPH_SQL = """
WITH RECURSIVE usable AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9
),
reached AS (
    SELECT vec_id, vec_id AS other FROM embeddings
    UNION
    SELECT vec_id, b FROM reached JOIN links ON a = other
),
components AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id)
SELECT c.vec_id, count(b) AS n_links, component_id, c.vec_id = component_id AS kept
FROM components c LEFT JOIN links ON a = c.vec_id GROUP BY c.vec_id, component_id
"""


FILTER_AUDIT_SQL = r"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
),
firsts AS (SELECT text, min(doc_id) AS first_id FROM texts GROUP BY text),
marks AS (
    SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
),
fails AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 3 * length(t.text) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(t.text, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN t.doc_id > first_id THEN 'E' ELSE '' END AS failed
    FROM texts t JOIN firsts f ON f.text = t.text LEFT JOIN marks m ON m.doc_id = t.doc_id
),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
),
removed_at AS (
    SELECT part, filter_order, good, toxic, failed,
        CASE WHEN failed = '' THEN 6
            ELSE list_min(list_transform(string_split(failed, ''), lambda x: position(x IN filter_order))) END AS gone
    FROM fails CROSS JOIN orders
),
steps AS (
    SELECT part, filter_order, step, filter_order[step] AS l, gone, good, toxic, failed
    FROM removed_at CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS step)
),
summed AS (
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, l,
        count(*) FILTER (gone > step) AS kept,
        count(*) FILTER (gone = step) AS removed,
        count(*) FILTER (gone < step AND contains(failed, l)) AS redundant,
        count(*) FILTER (failed = l) AS unique_fails,
        count(*) FILTER (gone = step AND good) AS good_lost,
        count(*) FILTER (gone = step AND toxic) AS toxic_lost
    FROM steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley
FROM summed
"""


HARD_NEGATIVES_SQL = """
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
),
positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
    other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
    AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) <= 5
"""


def oracle_sql() -> dict[str, str]:
    """What the results must equal, on tables in which ids are unique."""
    return {
        "op1_licenses": _licenses_sql(),
        "op2_vector_graph": VECTOR_GRAPH_SQL,
        "op6_ngram_join": NGRAM_JOIN_SQL,
        "op9_exact_dedup": EXACT_DEDUP_SQL,
        "op12_filter_audit": FILTER_AUDIT_SQL,
        "op13_hard_negatives": HARD_NEGATIVES_SQL,
    }
