"""Transactions as logs: states, expiry, illegal steps, reads of own writes, and what a commit applies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Event to the state it leads to; from which states it may come (begin: from none).
STATES = {"begin": "Active", "prepare": "Preparing", "commit": "Committed", "abort": "Aborted"}
ALLOWED = {"begin": (None,), "prepare": ("begin",), "commit": ("prepare",), "abort": ("begin", "prepare", "commit", "abort")}
TIMEOUT_MS = 30_000


def final_state(log: DataFrame) -> DataFrame:
    """(tx_id, state): where each transaction's last event has left it."""
    last = log.groupBy("tx_id").agg(F.max_by("event", F.struct("ts", "log_pos")).alias("event"))
    state = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    return last.select("tx_id", F.element_at(state, F.col("event")).alias("state"))


def illegal_steps(log: DataFrame) -> DataFrame:
    """Events that may not follow the one before in their transaction."""
    own = Window.partitionBy("tx_id").orderBy("ts", "log_pos")
    before = log.withColumn("previous", F.lag("event").over(own))
    legal = F.lit(False)
    for event, sources in ALLOWED.items():
        for source in sources:
            legal = legal | ((F.col("event") == event) & (F.col("previous").isNull() if source is None else F.col("previous") == source).eqNullSafe(F.lit(True)))
    return before.filter(~legal)


def expired(log: DataFrame, now: int, timeout_ms: int = TIMEOUT_MS) -> DataFrame:
    """Transactions still active or preparing whose beginning is longer ago than the timeout."""
    begun = log.groupBy("tx_id").agg(F.min(F.when(F.col("event") == "begin", F.col("ts"))).alias("started"), F.max_by("event", F.struct("ts", "log_pos")).alias("event"))
    return begun.filter(F.col("event").isin("begin", "prepare") & (F.lit(now) - F.col("started") > timeout_ms)).select("tx_id", "started")


def transaction(log: DataFrame, operations: DataFrame, tx_id: str) -> DataFrame:
    """An active transaction with its operations so far: (tx_id, state, started, op_seq, kind, key, value); no row if it has ended."""
    own = final_state(log.filter(F.col("tx_id") == tx_id)).filter(F.col("state").isin("Active", "Preparing"))
    begun = log.filter((F.col("tx_id") == tx_id) & (F.col("event") == "begin")).groupBy("tx_id").agg(F.min("ts").alias("started"))
    return own.join(begun, "tx_id").join(operations.filter(F.col("tx_id") == tx_id), "tx_id", "left").select("tx_id", "state", "started", "op_seq", "kind", "key", "value")


def active_count(log: DataFrame) -> DataFrame:
    return final_state(log).agg(F.count_if(F.col("state").isin("Active", "Preparing")).alias("active"))


def write_sets(operations: DataFrame) -> DataFrame:
    """(tx_id, key, value): the last write of each key; a delete writes an empty value."""
    writes = operations.filter(F.lower("kind").isin("put", "delete"))
    value = F.when(F.lower("kind") == "put", F.col("value")).otherwise(F.lit(b""))
    return writes.withColumn("value", value).groupBy("tx_id", "key").agg(F.max_by("value", "op_seq").alias("value"), F.max("op_seq").alias("op_seq"))


def read_sets(operations: DataFrame) -> DataFrame:
    return operations.filter(F.lower("kind") == "get").select("tx_id", "key").distinct()


def reads(operations: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each get with what it sees: its transaction's own latest earlier write, else the ledger's record."""
    by = Window.partitionBy("tx_id", "key").orderBy("op_seq").rowsBetween(Window.unboundedPreceding, -1)
    written = F.when(F.lower("kind") == "put", F.col("value")).when(F.lower("kind") == "delete", F.lit(b""))
    own = operations.withColumn("own", F.last(written, ignorenulls=True).over(by)).filter(F.lower("kind") == "get")
    stored = ledger.select("key", F.col("value").alias("stored"))
    return own.join(stored, "key", "left").select("tx_id", "op_seq", "key", F.coalesce("own", "stored").alias("value"), F.col("own").isNotNull().alias("from_own_write"))


def committed_writes(operations: DataFrame, log: DataFrame) -> DataFrame:
    """What the committed transactions put, with the time of their commit: one batch for the ledger."""
    done = log.filter("event = 'commit'").groupBy("tx_id").agg(F.max("ts").alias("timestamp"))
    puts = operations.filter(F.lower("kind") == "put").groupBy("tx_id", "key").agg(F.max_by("value", "op_seq").alias("value"), F.max("op_seq").alias("op_seq"))
    return puts.join(done, "tx_id")


def two_phase(votes: DataFrame) -> DataFrame:
    """(tx_id, decision): commit only if every participant has voted for it."""
    return votes.groupBy("tx_id").agg(F.when(F.bool_and(F.coalesce("vote", F.lit(False))), "commit").otherwise("abort").alias("decision"))
