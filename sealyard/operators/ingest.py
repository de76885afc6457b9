"""First writer wins: a key is accepted once, in arrival order, and never again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import record_hash
from .checkpoints import cut
from .ordering import numbered


def with_status(batch: DataFrame, ledger: DataFrame | None, arrival: Sequence[Column]) -> DataFrame:
    """Adds status to each row of a batch: accepted, duplicate_in_batch, or duplicate_key if the ledger has it.

    arrival must order all rows of a key; of rows that tie on it any one is the first. Keys are not null.
    """
    # The rows are written once, numbered. The winner of each key is found by partial aggregation, so a hot key's rows are sorted nowhere.
    rows = cut(batch.withColumn("__row", F.monotonically_increasing_id()))
    won = rows.groupBy("key").agg(F.min_by("__row", F.struct(*arrival, "__row")).alias("__won"))
    known = F.lit(False)
    if ledger is not None:
        won = won.join(ledger.select("key", F.lit(True).alias("__known")), "key", "left")
        known = F.coalesce("__known", F.lit(False))
    status = F.when(known, "duplicate_key").when(F.col("__row") == F.col("__won"), "accepted").otherwise("duplicate_in_batch")
    return rows.join(won, "key").withColumn("status", status).drop("__row", "__won", "__known")


def accepted(batch: DataFrame, ledger: DataFrame | None, arrival: Sequence[Column]) -> DataFrame:
    """The rows that win: the first of each new key. Partial aggregation leaves one row of a hot key for each task."""
    rest = [c for c in batch.columns if c != "key"]
    first = batch.groupBy("key").agg(F.min_by(F.struct(*rest), F.struct(*arrival)).alias("r")).select("key", "r.*")
    return first if ledger is None else first.join(ledger.select("key"), "key", "left_anti")


def records(rows: DataFrame, by: str, ties: Sequence[Column] = (), start: int = 1) -> DataFrame:
    """(key, value, timestamp) and an order to records with sequence numbers and hashes."""
    with_seq = numbered(rows, by, ties, "sequence_number", start)
    return with_seq.select("key", "value", "timestamp", "sequence_number", record_hash("key", "value", "timestamp", "sequence_number").alias("hash"))
