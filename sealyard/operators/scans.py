"""Reads: lookups, ranges, prefixes, pages. Each is a filter that Parquet's statistics can prune by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codec import has_prefix


def get(ledger: DataFrame, key: bytes) -> DataFrame:
    return ledger.filter(F.col("key") == F.lit(key)).limit(1)


def multi_get(ledger: DataFrame, keys: DataFrame) -> DataFrame:
    """Records of the wanted keys. The planner broadcasts the keys only if they are few."""
    return ledger.join(keys.select("key").distinct(), "key")


def existing(keys: DataFrame, ledger: DataFrame) -> DataFrame:
    """The keys that the ledger has."""
    return keys.join(ledger.select("key"), "key", "left_semi")


def absent(keys: DataFrame, ledger: DataFrame) -> DataFrame:
    return keys.join(ledger.select("key"), "key", "left_anti")


def scan_range(ledger: DataFrame, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
    """Keys from start, before end."""
    if start is not None:
        ledger = ledger.filter(F.col("key") >= F.lit(start))
    return ledger if end is None else ledger.filter(F.col("key") < F.lit(end))


def scan_prefix(ledger: DataFrame, prefix: bytes) -> DataFrame:
    return ledger.filter(has_prefix("key", prefix))


def in_order(ledger: DataFrame) -> DataFrame:
    """All records by key; a range sort, so no task holds all."""
    return ledger.orderBy("key")


def latest_by_prefix(ledger: DataFrame, prefix: bytes) -> DataFrame:
    """The record of the greatest key with the prefix."""
    return scan_prefix(ledger, prefix).orderBy(F.desc("key")).limit(1)


def first_last_key(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("n"))


def page(ledger: DataFrame, prefix: bytes = b"", limit: int = 100, offset: int = 0) -> DataFrame:
    """Keys in order, limit of them from offset, each with total_count and has_more."""
    found = scan_prefix(ledger, prefix)
    total = found.agg(F.count("*").alias("total_count"))
    rows = found.orderBy("key").offset(offset).limit(limit)
    return rows.crossJoin(F.broadcast(total)).withColumn("has_more", F.lit(offset + limit) < F.col("total_count"))


def recovered(log: DataFrame) -> DataFrame:
    """From a replayed log the last record of each key."""
    rest = [c for c in log.columns if c != "key"]
    newest = log.groupBy("key").agg(F.max_by(F.struct(*rest), "sequence_number").alias("r"))
    return newest.select("key", "r.*")


def fresh(cache: DataFrame, now: int, ttl_ms: int = 1000) -> DataFrame:
    """Cached reads that are still valid."""
    return cache.filter(F.lit(now) - F.col("ts") < ttl_ms)


def living(records: DataFrame, now: int, ttl_seconds: int | None) -> DataFrame:
    """Records that a collection's time to live still shows; they stay in the ledger."""
    return records if ttl_seconds is None else records.filter(F.lit(now) - F.col("timestamp") < ttl_seconds * 1000)


def entries_from(log: DataFrame, index: int) -> DataFrame:
    """A replicated log's suffix."""
    return log.filter(F.col("index") >= index)


def hit_miss(reads: DataFrame, ledger: DataFrame) -> DataFrame:
    """Reads, hits and misses of the wanted keys."""
    known = ledger.select("key").distinct().withColumn("found", F.lit(True))
    return reads.join(known, "key", "left").agg(F.count("*").alias("reads"), F.count_if(F.col("found")).alias("cache_hits"), F.count_if(F.col("found").isNull()).alias("cache_misses"))
