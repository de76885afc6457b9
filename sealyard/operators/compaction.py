"""Merging runs of records: the later run wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels, and the runs that each may hold before it is merged into the next.
LEVELS = 7


def limit(level: int) -> int:
    return 10 ** (level + 1)


def merged(runs: DataFrame, order: str = "run_order") -> DataFrame:
    """One row for each key, from the run of the highest order. Partial aggregation keeps one row of a key for each task."""
    rest = [c for c in runs.columns if c not in ("key", order)]
    return runs.groupBy("key").agg(F.max_by(F.struct(*rest), order).alias("r")).select("key", "r.*")


def level_info(segments: DataFrame) -> DataFrame:
    """(level, runs, rows, due): whether a level holds more runs than it may."""
    most = F.pow(F.lit(10), F.col("level") + 1)
    return segments.groupBy("level").agg(F.count("*").alias("runs"), F.sum("rows").alias("rows")).withColumn("due", (F.col("runs") > most) & (F.col("level") < LEVELS - 1))
