"""The corpus pipeline: toxic documents go, one of each group of near duplicates stays, contaminated documents go, sources are mixed, shards are dealt.

Each stage takes (spark, docs, sf_dir), docs being what the stage before kept, and returns the columns of documents; the last adds shard and slot.
Each stage's rows are written as Parquet, into the cluster's shared folder, and read again; a stage's rows go when the next one's are written, so
of the corpus one copy is left, which the result reads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealyard.llm import decontam, hyperminhash, mixing, sharding, toxicity
from sealyard.llm.common import discard, release, shared_folder, table

SHARDS = 16


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the model, learned from the labels of these documents, scores below its threshold."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group that shares 0.8 of its five-word shingles."""
    return hyperminhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of which benchmark windows hit less than a twentieth of the words."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for; repeats are rows of their own."""
    return mixing.mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the shard that doc_id descends to, and a number in it."""
    placed = sharding.assign_shards(docs, "doc_id", sharding.even_tree(SHARDS))
    numbered = sharding.with_slots(placed.withColumn("__order", F.xxhash64("text")), "doc_id", ["doc_id", "__order"])
    return numbered.select(*docs.columns, "shard", "slot")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The models and sketches of the first stages are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared, before = shared_folder(spark), None
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            discard(spark, before)
        release(spark)
        before = path
    return docs
