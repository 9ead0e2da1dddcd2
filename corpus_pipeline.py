"""A training corpus from raw documents: each stage takes what the one before kept.

Each stage function takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet in the shared folder and reads it again as the next stage's documents.
Decisions are made on ids and hashes. Toxicity and decontamination drop documents in the pass
that reads their texts; dedup and mixing join small decisions to the texts, without a shuffle
while Spark finds those small enough to broadcast; tokens need one shuffle, into doc_id order.

Defined cases, for every stage: a null or empty text is not toxic, has fingerprint zero (so of
all such documents one stays), holds no passage, has no words to mix, and so is not in the mix;
in the last stage it is the end id alone. A null doc_id is a document like any other: the
first two stages carry it, dedup takes it last in a component, the store puts it first. A null lang or source is a value of its own. Rows
repeating a doc_id are documents of their own, but that equal rows are near-duplicates. Texts
of any length are read whole. Ties: dedup keeps the least doc_id, then by hashes. An empty
table goes through every stage as one. Extra columns, whatever their names, are kept by all
stages but the last, whose rows are doc_id, start, n_tokens and ids_crc32.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from motifspark.llm import decontaminate, mixing, simhash_dedup, token_store, toxicity
from motifspark.llm.common import table, written
from motifspark.llm.queries import toxic_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar scores below 0.5; labels are looked up by doc_id in the table of labels."""
    return toxicity.filtered(docs, toxic_model(spark, docs, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the least doc_id."""
    return simhash_dedup.deduplicated(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by target weights: a row for each document and epoch drawn."""
    return mixing.mixed(docs)


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as ORC, and the digest of what the files hold."""
    return token_store.tokenised(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("mixing", mix_sources),
    ("token_store", store_tokens),
]

#: Models, XXH64 and the tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
