"""The queries of the ten operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_topk, hilbert_shards, html_extract, language_id, mixing, quality, simhash_dedup, token_store, toxicity
from .common import id_crc, table


def held(fold: int, rest: int):
    return F.coalesce(F.pmod(id_crc(), F.lit(fold)) == rest, F.lit(False))


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.drawn_words(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(~held(5, 0)))
    return language_id.identified(docs, model).withColumn("held_out", held(5, 0))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def toxic_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.ToxicModel:
    return toxicity.train(quality.labelled(docs, table(spark, sf_dir, "labels"), "toxic", 5, 0, toxicity.SAMPLE))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.scored(docs, toxic_model(spark, docs, sf_dir))
    return out.withColumn("held_out", held(5, 0)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(quality.labelled(docs, table(spark, sf_dir, "labels"), "quality", 4, 2, quality.SAMPLE))
    out = quality.scored(docs, model)
    return out.withColumn("held_out", held(4, 2)).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.tokenised(table(spark, sf_dir, "documents"))


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards.sharded(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_exact_topk, op2_simhash_dedup, op3_mixing, op4_language_id, op5_html_extract,
    op6_decontaminate, op7_toxicity, op8_quality, op9_token_store, op10_hilbert_shards)}

#: The others need XXH64, crc32, a trained model, a tokenizer or pseudorandom draws, which the
#: checking SQL engine does not have; tests hold them against brute force.
ORACLE_SQL = {
    "op1_exact_topk": """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), n AS MATERIALIZED (SELECT * FROM v), s AS (
  SELECT q.row AS row, q.vec_id AS query_id, p.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.c, p.c), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM n q JOIN n p ON q.row <> p.row AND len(q.c) = len(p.c)
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM s
)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 10
""",
}
