"""Counters of collections, always derived from the records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collection_stats(records: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """(collection_id, document_count, total_size_bytes, last_updated); with a catalog also its empty collections."""
    found = records.groupBy("collection_id").agg(
        F.count("*").alias("document_count"),
        F.sum((F.octet_length("key") + F.octet_length("value")).cast("long")).alias("total_size_bytes"),
        F.max("timestamp").alias("last_updated"),
    )
    if catalog is None:
        return found
    full = catalog.select("collection_id").join(found, "collection_id", "left")
    return full.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("document_count", "total_size_bytes")})


def total_stats(records: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """(collections, documents, bytes) over all collections."""
    return collection_stats(records, catalog).agg(
        F.count("*").alias("collections"), F.coalesce(F.sum("document_count"), F.lit(0)).alias("documents"), F.coalesce(F.sum("total_size_bytes"), F.lit(0)).alias("bytes")
    )


def rolled_up(records: DataFrame) -> DataFrame:
    """Each collection's documents and bytes, and those of all in one row without a collection."""
    size = F.sum((F.octet_length("key") + F.octet_length("value")).cast("long"))
    return records.rollup("collection_id").agg(F.count("*").alias("documents"), size.alias("bytes"))
