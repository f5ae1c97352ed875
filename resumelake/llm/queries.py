"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resumelake.llm import classlm, idcoder, kdsearch, packing, pieces, pqdedup, sharding, simhash, surrogates, toxicity
from resumelake.llm.shared import crc_of_id, table


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), k=3, words=1, radius=2)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classlm.scored(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idcoder.round_trip(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 40)


def op6_pq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pqdedup.near_vectors(table(spark, sf_dir, "embeddings"), 0.98)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (crc_of_id(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdsearch.top_k(kdsearch.scaled(table(spark, sf_dir, "embeddings"), 256), k=5, every=50)


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymized(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_simhash_dedup, op2_class_lm, op3_packing, op4_token_files, op5_sharding, op6_pq_dedup, op7_sentencepiece, op8_toxicity, op9_topk, op10_surrogates)}
ORACLE_SQL = {
    "op6_pq_dedup": """
        WITH RECURSIVE good AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), pairs AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98
        ), reach AS (
            SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT pairs.b, reach.root FROM reach JOIN pairs ON pairs.a = reach.vec_id
        ), n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
        SELECT reach.vec_id, coalesce(max(n.n), 0)::BIGINT AS n_links, min(root) AS component_id, reach.vec_id = min(root) AS kept
        FROM reach LEFT JOIN n ON n.a = reach.vec_id GROUP BY reach.vec_id""",
    "op9_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
