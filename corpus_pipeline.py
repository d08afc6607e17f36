"""The corpus pipeline: STAGES over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import decontaminate, mixing, simhash, tokenids, toxicity
from kinfold.llm.common import TEXTS, materialize, table
from kinfold.llm.queries import TOXIC, tokenizer_path, toxicity_models


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not find toxic."""
    models = toxicity_models(docs, table(spark, sf_dir, "labels"))
    keep = {f"__c{i}": c for i, c in enumerate(docs.columns)}
    d = docs.select(*[F.col(f"`{c}`").alias(k) for k, c in keep.items()], F.col("text"))
    return toxicity.score(d, models, tuple(keep)).where(~F.col(f"is_{TOXIC}")).select(*[F.col(k).alias(c) for k, c in keep.items()])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id, of any of these or of rows without id."""
    # Rows are told apart by a key that is written once, not by doc_id, which can be null or repeated.
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "rows", codec=TEXTS)
    groups = simhash.near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__row"), "component_id")
    members = materialize(groups.join(rows.select("__row", "doc_id"), "__row"), "members")
    # The minimum is combined before the shuffle, so a group of any size costs its task a row a partition.
    stays = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("m")).select(F.col("m.__row").alias("__row"))
    return rows.join(stays, "__row", "left_semi").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokenids.round_trip(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix_sources), ("token_ids", token_ids)]

#: The model, the fingerprints (XXH64) and the tokenizer have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
