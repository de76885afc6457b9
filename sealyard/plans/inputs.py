"""Ledger inputs derived from the shared tables; `oracles` derives the same with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import records

BATCH = 37


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).cast("binary")


def millis(c: str):
    return F.unix_millis(F.col(c).cast("timestamp"))


def order_puts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(text("order:", F.col("o_orderkey")).alias("key"), text(F.col("o_orderstatus"), "|", F.col("o_orderpriority")).alias("value"), millis("o_orderdate").alias("timestamp"), F.col("o_orderkey").alias("n"))


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(order_puts(spark, sf_dir), "n")


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(text(F.col("lang"), ":", F.col("source"), ":", F.col("doc_id")).alias("key"), F.col("text").cast("binary").alias("value"), F.col("doc_id").alias("timestamp"))


def line_puts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    value = text(F.col("l_partkey"), "|", F.col("l_suppkey"), "|", F.col("l_quantity").cast("int"), "|", F.col("l_returnflag"))
    order = F.struct(millis("l_shipdate").alias("a"), F.col("l_partkey").alias("b"), F.col("l_suppkey").alias("c"), F.col("l_quantity").alias("d"), F.col("l_extendedprice").alias("e"), F.col("l_discount").alias("f"), F.col("l_tax").alias("g"), F.col("l_returnflag").alias("h"), F.col("l_linestatus").alias("i"))
    return li.select(text(F.col("l_orderkey"), ":", F.col("l_linenumber")).alias("key"), value.alias("value"), millis("l_shipdate").alias("timestamp"), order.alias("arrival"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("e", F.col("event_id"))


def txn_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx, pos = F.floor(F.col("e") / 5), F.col("e") % 5
    event = (
        F.when(pos == 0, "begin")
        .when(pos == 1, F.when(tx % 4 == 3, "commit").otherwise("prepare"))
        .when((pos == 2) & (tx % 4 == 0), "commit")
        .when((pos == 2) & (tx % 4 == 1), "abort")
    )
    return events(spark, sf_dir).select(tx.cast("string").alias("tx_id"), event.alias("event"), (F.col("e") * 1000).alias("ts"), F.col("e").alias("log_pos")).filter("event IS NOT NULL")


def txn_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("put"), F.lit("get"), F.lit("delete")), (F.floor(F.col("e") / 2) % 3 + 1).cast("int"))
    return events(spark, sf_dir).select(F.floor(F.col("e") / 5).cast("string").alias("tx_id"), (F.col("e") % 5).alias("op_seq"), kind.alias("kind"), text("order:", F.col("user_id") % 4).alias("key"), text(F.col("event_type"), F.col("e")).alias("value"))


def held_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).filter("e % 2 = 0")
    rows = e.select(text("k", F.col("user_id")).alias("key"), (F.col("e") % 97).cast("string").alias("tx_id"), F.when(F.col("e") % 8 == 0, "exclusive").otherwise("shared").alias("mode"))
    return rows.groupBy("key", "tx_id").agg(F.min("mode").alias("mode"))


def lock_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).filter("e % 2 = 1")
    return e.select(text("k", F.col("user_id") % 170).alias("key"), (F.col("e") % 97).cast("string").alias("tx_id"), F.when(F.col("e") % 3 == 0, "exclusive").otherwise("shared").alias("mode"), F.col("e").alias("requested_at"))


def wait_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a transaction that waits for two others of its hundred, but every third one waits for none."""
    e, base = F.col("e"), F.col("e") - F.col("e") % 100
    blockers = F.array((base + (e * 7 + 3) % 100).cast("string"), (base + F.col("user_id") % 100).cast("string"))
    return events(spark, sf_dir).filter("e % 3 <> 0").select(e.cast("string").alias("tx_id"), F.explode(blockers).alias("blocker")).filter("tx_id <> blocker")


def raft_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is an entry of one of five nodes; a node lags behind by so many twentieths of the log as its number says."""
    index = F.floor(F.col("e") / 5) + 1
    rows = events(spark, sf_dir).select(F.concat(F.lit("n"), (F.col("e") % 5).cast("string")).alias("node_id"), index.alias("index"), (F.floor(index / 50) + 1).alias("term"), F.lit("put").alias("kind"), text("k", index).alias("key"), text("v", index + F.when(F.col("e") % 499 == 0, 1).otherwise(0)).alias("value"))
    last = events(spark, sf_dir).agg((F.floor(F.max("e") / 5) + 1).alias("last"))
    lag = F.floor(F.col("last") * F.substring("node_id", 2, 1).cast("int") / 20)
    return rows.crossJoin(F.broadcast(last)).filter(F.col("index") <= F.col("last") - lag).drop("last")


def permission_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("Read", "Write", "ModifyUser", "GrantPermission", "ViewStats", "Admin")))
    e = F.col("e")
    permission = F.element_at(names, (F.when(e % 61 == 0, 5).otherwise(e % 5) + 1).cast("int"))
    return events(spark, sf_dir).select(e.alias("event_id"), (e * 10).alias("ts"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"), permission.alias("permission"), F.when(F.floor(e / 3) % 3 == 0, "revoke").otherwise("grant").alias("action"), F.lit("root").alias("actor"))


def logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("e").alias("event_id"), (F.col("e") * 10).alias("ts"), F.col("user_id").cast("string").alias("user_id"), (F.col("e") % 4 == 0).alias("success"))


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.hashing import permissions_root

    c = table(spark, sf_dir, "customer")
    perms = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("Write"), F.lit("Read"))).otherwise(F.array(F.lit("Read")))
    return c.select(F.col("c_custkey").alias("position"), F.col("c_name").alias("user_id"), F.unhex(F.sha2(F.col("c_name").cast("binary"), 256)).alias("public_key"), (F.col("c_custkey") % 7).cast("long").alias("creation_block"), (F.col("c_custkey") * 1000).cast("long").alias("creation_timestamp"), permissions_root(perms).alias("permissions_root"))
