"""The thin queries of this folder's operators over whole tables, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.store import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import postings

    return postings.contamination(postings.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import rules

    return rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import licences

    return licences.licences(table(spark, sf_dir, "documents")).drop("matches")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import crf

    return crf.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import pivots

    return pivots.search(table(spark, sf_dir, "embeddings"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import domtree

    return domtree.extract(table(spark, sf_dir, "pages"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import suffixdedup

    return suffixdedup.digest(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessella.llm import bpe

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import ring

    placed = ring.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_quality": op2_quality,
        "op3_licences": op3_licences,
        "op4_toxicity": op4_toxicity,
        "op5_pivot_search": op5_pivot_search,
        "op6_html": op6_html,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_simhash": op8_simhash,
        "op9_bpe": op9_bpe,
        "op10_sharding": op10_sharding,
    }


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def oracle_sql() -> dict[str, str]:
    """SQL over whole tables; the other operators are held to brute force or held-out rows in tests/llm."""
    return {
        "op1_decontamination": f"""
            WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
            spots AS (SELECT item_id, w, LEAST(13, len(w)) AS n, UNNEST(RANGE(1, GREATEST(1, len(w) - 12) + 1)) AS s FROM b WHERE len(w) > 0),
            windows AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS g FROM spots),
            places AS (SELECT doc_id, w, n, UNNEST(RANGE(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
            hits AS (SELECT p.doc_id, p.s, p.n, x.item_id FROM (SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS g FROM places) p JOIN windows x ON x.n = p.n AND x.g = p.g),
            words AS (SELECT doc_id, COUNT(DISTINCT i) AS n_hit FROM (SELECT doc_id, UNNEST(RANGE(s, s + n)) AS i FROM hits) GROUP BY doc_id),
            items AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
            SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, sha256(COALESCE(ids, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= len(w) AS contaminated
            FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id""",
        "op5_pivot_search": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings),
            s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
            SELECT query_id, CAST(r AS INT) AS rank, vec_id, score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 20""",
    }
