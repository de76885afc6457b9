"""One query for each operator: (spark, sf_dir) to a DataFrame. Digests are lowercase hexadecimal text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, hashing
from ..functions.codec import hex_lower
from ..operators import blocks, compaction, identity, indexes, ingest, locks, replication, scans, stats, transactions, validation, verify
from ..operators.checkpoints import cut
from . import inputs as I
from .inputs import BATCH, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _s(c: str):
    return F.col(c).cast("string").alias(c)


def _plain(df: DataFrame) -> DataFrame:
    """Keys and values as text."""
    return df.withColumns({c: F.col(c).cast("string") for c in ("key", "value") if c in df.columns})


def _chain(spark, sf_dir):
    """The chain and its records. Both are written once: numbering and chaining run once, whatever reads them."""
    r = cut(I.order_records(spark, sf_dir))
    first = blocks.genesis(spark)
    return cut(first.unionByName(blocks.seal(r, bytes(first.first().hash), BATCH))), r


# ---------------------------------------------------------------- integrity


@query
def ledger_blocks(spark, sf_dir):
    """The flagship: orders as records, sealed in blocks, chained, and each block verified."""
    chain, r = _chain(spark, sf_dir)
    checks = verify.verify_chain(chain, r, BATCH)
    valid = F.col("hash_ok") & F.col("root_ok") & F.col("link_ok") & F.col("count_ok") & F.col("records_ok")
    return chain.join(checks, "index").select("index", "timestamp", hex_lower("previous_hash").alias("previous_hash"), hex_lower("merkle_root").alias("merkle_root"), hex_lower("hash").alias("hash"), "n_records", valid.alias("valid"))


@query
def record_hash(spark, sf_dir):
    return I.order_records(spark, sf_dir).select(_s("key"), "sequence_number", hex_lower("hash").alias("hash"))


@query
def merkle_root_per_block(spark, sf_dir):
    return blocks.grouped(I.order_records(spark, sf_dir), BATCH).filter(F.col("n_records") == BATCH).select("index", hex_lower("merkle_root").alias("merkle_root"), "n_records")


@query
def verify_chain(spark, sf_dir):
    chain, r = _chain(spark, sf_dir)
    return verify.is_valid(verify.verify_chain(chain, r, BATCH))


@query
def verify_tampered(spark, sf_dir):
    """Values changed under their old hashes: chain mode doesn't see it, deep mode names the blocks."""
    chain, r = _chain(spark, sf_dir)
    bad = r.withColumn("value", F.when(F.col("sequence_number") % 1000 == 7, F.lit(b"forged")).otherwise(F.col("value")))
    shallow = verify.verify_chain(chain, bad, BATCH, deep=False).select("index", F.lit("chain").alias("mode"), (F.col("hash_ok") & F.col("root_ok") & F.col("link_ok")).alias("ok"))
    deep = verify.verify_chain(chain, bad, BATCH).filter("index > 0").select("index", F.lit("deep").alias("mode"), F.col("records_ok").alias("ok"))
    return shallow.unionByName(deep)


@query
def merkle_proof(spark, sf_dir):
    """Of every record of a full block."""
    r = cut(I.order_records(spark, sf_dir))
    found = verify.proofs(r.select("hash"), r, BATCH)
    steps = F.array_join(F.transform("proof", lambda p: F.concat(F.when(p["is_left"], "L").otherwise("R"), hex_lower(p["sibling"]))), ",")
    return found.select(hex_lower("hash").alias("hash"), "index", "place", steps.alias("proof"))


@query
def proof_roundtrip(spark, sf_dir):
    r = cut(I.order_records(spark, sf_dir))
    return verify.verify_proofs(verify.proofs(r.select("hash"), r, BATCH)).groupBy("proved").agg(F.count("*").alias("n"))


@query
def forced_blocks(spark, sf_dir):
    """The last records are sealed too, in a block that isn't full."""
    chain = blocks.seal(cut(I.order_records(spark, sf_dir)), bytes(blocks.genesis(spark).first().hash), BATCH, force=True)
    return chain.select("index", "n_records", "first_sequence", hex_lower("merkle_root").alias("merkle_root"))


@query
def chain_tip(spark, sf_dir):
    return verify.tip(_chain(spark, sf_dir)[0]).select("index", "n_records", hex_lower("merkle_root").alias("merkle_root"), "length")


@query
def block_by_index(spark, sf_dir):
    return verify.block_at(_chain(spark, sf_dir)[0], 7).select("index", "timestamp", "n_records", "first_sequence", hex_lower("merkle_root").alias("merkle_root"))


@query
def integrity_of_all(spark, sf_dir):
    """The chain of the data and that of the identities, the latter with one forged entry."""
    chain, r = _chain(spark, sf_dir)
    people = identity.identity_chain(I.identities(spark, sf_dir))
    forged = people.withColumn("creation_block", F.when(F.col("position") == 100, F.lit(99).cast("long")).otherwise(F.col("creation_block")))
    checks = verify.verify_chain(chain, r, BATCH)
    rows = [verify.all_valid(checks, identity.verify_identity_chain(x)).withColumn("people", F.lit(name)) for name, x in (("true", people), ("forged", forged))]
    return rows[0].unionByName(rows[1])


# ---------------------------------------------------------------- scans


@query
def point_get(spark, sf_dir):
    return _plain(scans.get(I.order_records(spark, sf_dir), b"order:7").select("key", "value"))


@query
def multi_get(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(I.text("order:", F.col("l_orderkey")).alias("key"))
    return _plain(scans.multi_get(I.order_records(spark, sf_dir), keys).select("key", "value", "sequence_number"))


@query
def key_exists(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(I.text("order:", F.col("c_custkey") * 3).alias("key"))
    r = I.order_puts(spark, sf_dir)
    return _plain(scans.existing(keys, r).withColumn("found", F.lit(True)).unionByName(scans.absent(keys, r).withColumn("found", F.lit(False))))


@query
def scan_range(spark, sf_dir):
    return _plain(scans.scan_range(I.order_puts(spark, sf_dir), b"order:2", b"order:5").select("key", "value"))


@query
def scan_prefix(spark, sf_dir):
    return _plain(scans.scan_prefix(I.document_records(spark, sf_dir), b"en:src1").select("key", "timestamp"))


@query
def latest_by_prefix(spark, sf_dir):
    return _plain(scans.latest_by_prefix(I.order_puts(spark, sf_dir), b"order:9").select("key", "value"))


@query
def scan_in_order(spark, sf_dir):
    return _plain(scans.in_order(I.order_puts(spark, sf_dir)).select("key", "timestamp"))


@query
def first_last_key(spark, sf_dir):
    return scans.first_last_key(I.document_records(spark, sf_dir)).select(_s("first_key"), _s("last_key"), "n")


@query
def list_docs_page(spark, sf_dir):
    return _plain(scans.page(I.document_records(spark, sf_dir).select("key", "timestamp"), b"de:", 25, 50))


@query
def recovered_log(spark, sf_dir):
    log = I.events(spark, sf_dir).select(I.text(F.col("user_id"), ":", F.col("event_type")).alias("key"), I.text(F.col("value")).alias("raw"), F.col("event_id").alias("sequence_number"))
    return _plain(scans.recovered(log.withColumn("value", I.text("v", F.col("sequence_number"))).select("key", "value", "sequence_number")))


@query
def cache_fresh(spark, sf_dir):
    cache = I.events(spark, sf_dir).select(F.col("event_id"), (F.col("event_id") * 17 % 5000).alias("ts"))
    return scans.fresh(cache, 5000)


@query
def api_hit_miss(spark, sf_dir):
    reads = I.events(spark, sf_dir).select(I.text("order:", F.col("event_id") % 997).alias("key"))
    return scans.hit_miss(reads, I.order_puts(spark, sf_dir))


# ---------------------------------------------------------------- writes


@query
def append_accept(spark, sf_dir):
    won = ingest.accepted(I.line_puts(spark, sf_dir), None, [F.col("arrival"), F.col("value")])
    return _plain(won.select("key", "value", "timestamp"))


@query
def append_records(spark, sf_dir):
    """New keys only, after those that the ledger has; sequence numbers go on where it ends."""
    puts = I.order_puts(spark, sf_dir)
    known = puts.filter("n % 3 = 0")
    new = ingest.accepted(puts, known, [F.col("n")])
    return _plain(ingest.records(new, "n", start=100_001).select("key", "sequence_number", hex_lower("hash").alias("hash")))


@query
def batch_status(spark, sf_dir):
    puts = I.line_puts(spark, sf_dir)
    known = table(spark, sf_dir, "orders").filter("o_orderkey % 10 = 0").select(I.text(F.col("o_orderkey"), ":1").alias("key"))
    return ingest.with_status(puts, known, [F.col("arrival"), F.col("value")]).groupBy("status").agg(F.count("*").alias("n"))


@query
def compact_lww(spark, sf_dir):
    e = I.events(spark, sf_dir)
    runs = e.groupBy(I.text(F.col("user_id"), ":", F.col("event_type")).alias("key"), (F.col("event_id") % 7).alias("run_order")).agg(F.max("event_id").alias("event_id"))
    return _plain(compaction.merged(runs))


@query
def level_info(spark, sf_dir):
    segments = I.events(spark, sf_dir).select((F.col("event_id") % 3).alias("level"), (F.col("event_id") % 11 + 1).alias("rows"))
    return compaction.level_info(segments)


@query
def record_size(spark, sf_dir):
    d = I.document_records(spark, sf_dir)
    return d.select(_s("key"), codec.record_size("key", "value", F.lit(bytes(32))).cast("long").alias("size"))


@query
def encode_base64(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", codec.encode_field(F.col("text").cast("binary"), F.lit("base64")).alias("encoded"))
    return d.select("doc_id", F.sha2(F.col("encoded").cast("binary"), 256).alias("encoded_sha256"), F.length(codec.decode_field("encoded", F.lit("base64"))).cast("long").alias("n_bytes"))


@query
def lossy_text(spark, sf_dir):
    """Values whose UTF-8 a stray byte breaks after the first letter."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    broken = F.concat(F.substring("text", 1, 1).cast("binary"), F.lit(b"\xff"), F.substring("text", 2, 20).cast("binary"))
    return d.select("doc_id", codec.encode_field(broken, F.lit("utf8")).alias("shown"))


@query
def listed_fields(spark, sf_dir):
    """Names of fields from a list as the command line takes it."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.explode(codec.field_list(F.concat("c_name", F.lit(" , "), "c_mktsegment", F.lit(",x")))).alias("field"))


@query
def operation_hash(spark, sf_dir):
    ops = I.txn_operations(spark, sf_dir).withColumn("nonce", F.col("op_seq").cast("long"))
    h = hashing.operation_hash("kind", "key", "value", "tx_id", "nonce", F.lit(1_700_000_000))
    return ops.select("tx_id", "op_seq", "kind", hex_lower(h).alias("hash"))


@query
def password_policy(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.substring("c_mktsegment", 1, 3), F.lower("c_name"), F.when(F.col("c_custkey") % 2 == 0, "!").otherwise("")).alias("p"))
    return p.select("c_custkey", codec.password_ok("p").alias("ok"), hex_lower(hashing.password_hash("p", F.lit(b"salt"))).alias("hash"))


# ---------------------------------------------------------------- collections


def _collections(spark, sf_dir):
    parts = [
        I.order_puts(spark, sf_dir).select(F.lit("orders").alias("collection_id"), "key", "value", "timestamp"),
        I.document_records(spark, sf_dir).select(F.lit("documents").alias("collection_id"), "key", "value", "timestamp"),
        table(spark, sf_dir, "customer").select(F.lit("customers").alias("collection_id"), I.text(F.col("c_custkey")).alias("key"), F.col("c_name").cast("binary").alias("value"), F.lit(5).cast("long").alias("timestamp")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def collection_stats(spark, sf_dir):
    catalog = spark.createDataFrame([("orders",), ("documents",), ("customers",), ("empty",)], "collection_id string")
    return stats.collection_stats(_collections(spark, sf_dir), catalog)


@query
def total_stats(spark, sf_dir):
    return stats.total_stats(_collections(spark, sf_dir))


@query
def stats_rollup(spark, sf_dir):
    return stats.rolled_up(_collections(spark, sf_dir))


@query
def schema_violations(spark, sf_dir):
    schema = validation.Schema({"k": validation.Field("Integer", True, None, {"MinValue": 10, "MaxValue": 90}), "name": validation.Field("String", rules={"MinLength": 3, "OneOf": ["click", "view"]})})
    e = I.events(spark, sf_dir)
    value = F.when(F.col("e") % 10 == 0, F.lit("{'k': 1}")).when(F.col("e") % 10 == 1, F.lit("{}")).when(F.col("e") % 10 == 2, F.lit('{"k": "x", "name": "ab"}')).otherwise(F.col("props"))
    return validation.validated(e.select("event_id", value.alias("value")), schema).select("event_id", F.array_join("violations", ";").alias("violations"))


@query
def index_lookup(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(I.text(F.col("c_custkey")).alias("key"), "c_nationkey")
    return _plain(indexes.lookup(indexes.build(c, ["c_nationkey"]), c_nationkey=7))


@query
def index_unique_violations(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(I.text(F.col("c_custkey")).alias("key"), "c_nationkey")
    return indexes.unique_violations(indexes.build(c, ["c_nationkey"], sparse=True), ["c_nationkey"])


@query
def cross_collection_join(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_distinct("c_custkey").alias("customers"))


# ---------------------------------------------------------------- transactions and locks


@query
def txn_final_state(spark, sf_dir):
    return transactions.final_state(I.txn_log(spark, sf_dir))


@query
def txn_illegal_steps(spark, sf_dir):
    return transactions.illegal_steps(I.txn_log(spark, sf_dir)).select("tx_id", "event", "previous", "log_pos")


@query
def txn_expired(spark, sf_dir):
    return transactions.expired(I.txn_log(spark, sf_dir), 1_000_000)


@query
def txn_active_count(spark, sf_dir):
    return transactions.active_count(I.txn_log(spark, sf_dir))


@query
def txn_write_set(spark, sf_dir):
    return _plain(transactions.write_sets(I.txn_operations(spark, sf_dir)))


@query
def txn_reads_own_writes(spark, sf_dir):
    return _plain(transactions.reads(I.txn_operations(spark, sf_dir), I.order_puts(spark, sf_dir)))


@query
def txn_committed_writes(spark, sf_dir):
    return _plain(transactions.committed_writes(I.txn_operations(spark, sf_dir), I.txn_log(spark, sf_dir)).select("tx_id", "key", "value", "timestamp"))


@query
def txn_read_set(spark, sf_dir):
    return _plain(transactions.read_sets(I.txn_operations(spark, sf_dir)))


@query
def txn_lookup(spark, sf_dir):
    """One transaction that is preparing, with its operations."""
    return _plain(transactions.transaction(I.txn_log(spark, sf_dir), I.txn_operations(spark, sf_dir), "6"))


@query
def two_phase_decision(spark, sf_dir):
    votes = I.events(spark, sf_dir).select((F.col("e") % 300).cast("string").alias("tx_id"), (F.col("e") % 31 != 0).alias("vote"))
    return transactions.two_phase(votes)


@query
def lock_grantable(spark, sf_dir):
    return _plain(locks.grantable(I.lock_requests(spark, sf_dir).select("key", "tx_id", "mode").distinct(), I.held_locks(spark, sf_dir)))


@query
def lock_queue(spark, sf_dir):
    return _plain(locks.granted_prefix(I.lock_requests(spark, sf_dir)).select("key", "tx_id", "requested_at", "granted"))


@query
def wait_for_graph(spark, sf_dir):
    waiting = locks.grantable(I.lock_requests(spark, sf_dir).select("key", "tx_id", "mode").distinct(), I.held_locks(spark, sf_dir)).filter("NOT granted")
    return locks.waits_for(waiting, I.held_locks(spark, sf_dir))


@query
def locks_released(spark, sf_dir):
    """Every fifth transaction lets all go, every seventh one key of its own."""
    held = I.held_locks(spark, sf_dir)
    some = held.filter("CAST(tx_id AS INT) % 7 = 0 AND mode = 'shared'").select("key", "tx_id")
    whole = held.filter("CAST(tx_id AS INT) % 5 = 0").select(F.lit(None).cast("binary").alias("key"), "tx_id").distinct()
    return _plain(locks.released(held, some.unionByName(whole)))


@query
def deadlock_members(spark, sf_dir):
    return locks.deadlocked(I.wait_edges(spark, sf_dir), cut)


# ---------------------------------------------------------------- replication


@query
def raft_last_entries(spark, sf_dir):
    return replication.last_entries(I.raft_log(spark, sf_dir))


@query
def raft_commit_index(spark, sf_dir):
    """For each term of the log."""
    log = I.raft_log(spark, sf_dir)
    return replication.commit_indexes(replication.last_entries(log).select("node_id", F.col("last_index").alias("match_index")), log)


@query
def raft_votes(spark, sf_dir):
    last = replication.last_entries(I.raft_log(spark, sf_dir))
    requests = last.select(F.lit(9).alias("term"), F.col("node_id").alias("candidate"), "last_index", "last_term")
    voters = last.select("node_id", F.lit(9).alias("current_term"), F.when(F.col("node_id") == "n1", "n1").alias("voted_for"), "last_index", "last_term")
    return replication.votes(requests, voters).select("candidate", "node_id", "granted")


@query
def raft_election(spark, sf_dir):
    return replication.elected(raft_votes(spark, sf_dir).withColumn("term", F.lit(9)), 5)


@query
def raft_unapplied(spark, sf_dir):
    """Entries that three of five nodes have, after the first half of them."""
    log, q = _committed(spark, sf_dir)
    return _plain(replication.unapplied(log.crossJoin(F.broadcast(q)), F.floor(F.col("quorum") / 2), F.col("quorum")).select("node_id", "index", "key"))


def _committed(spark, sf_dir):
    log = I.raft_log(spark, sf_dir)
    return log, replication.last_entries(log).agg(F.sort_array(F.collect_list("last_index"), asc=False).alias("m")).select(F.col("m")[2].alias("quorum"))


@query
def raft_applied(spark, sf_dir):
    """The committed entries of node 0 as puts into a ledger that has every tenth key."""
    log, q = _committed(spark, sf_dir)
    known = log.filter("node_id = 'n0' AND index % 10 = 0").select("key")
    return _plain(replication.applied(log.filter("node_id = 'n0'").crossJoin(F.broadcast(q)), known, F.lit(0), F.col("quorum")).select("key", "value", "index"))


@query
def raft_append(spark, sf_dir):
    """A leader's entries replace what a follower has from two thirds on."""
    log = I.raft_log(spark, sf_dir)
    last = replication.last_entries(log).filter("node_id = 'n3'").first().last_index
    previous = last * 2 // 3
    mine, new = log.filter("node_id = 'n3'"), log.filter((F.col("node_id") == "n0") & (F.col("index") > previous)).withColumn("node_id", F.lit("n3"))
    return _plain(replication.appended(mine, new, previous).select("node_id", "index", "term", "key", "value"))


def _states(spark, sf_dir):
    """Each event is a state that a node reports."""
    e = F.col("e")
    state = F.when(e % 13 == 0, "Leader").when(e % 3 == 0, "Candidate").otherwise("Follower")
    return I.events(spark, sf_dir).select((F.col("user_id") % 20).cast("string").alias("node_id"), e.alias("ts"), e.alias("seq"), (F.floor(e / 40) - F.when(e % 97 == 0, 2).otherwise(0)).alias("term"), state.alias("state"))


@query
def raft_leader(spark, sf_dir):
    return replication.leader(_states(spark, sf_dir))


@query
def raft_illegal_states(spark, sf_dir):
    return replication.state_changes(_states(spark, sf_dir)).select("node_id", "seq", "term", "state")


@query
def raft_incomplete_leaders(spark, sf_dir):
    """Leaders of a term that lack entries which three of five nodes have from earlier terms."""
    log, q = _committed(spark, sf_dir)
    leaders = log.select("term").distinct().select("term", F.concat(F.lit("n"), (F.col("term") % 5).cast("string")).alias("leader_id"))
    done = log.crossJoin(F.broadcast(q)).filter("index <= quorum").select("index", "term").distinct()
    return replication.incomplete_leaders(leaders, log, done)


@query
def raft_read_only(spark, sf_dir):
    """Entries that need consensus, by kind."""
    e = F.col("e")
    kinds = F.when(e % 7 == 0, "noop").when(e % 3 == 0, "delete").otherwise("put")
    return replication.requires_consensus(I.events(spark, sf_dir).select(kinds.alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query
def raft_leader_safety(spark, sf_dir):
    leaders = I.events(spark, sf_dir).select(F.floor(F.col("e") / 100).alias("term"), F.when(F.col("e") % 700 == 0, "n2").otherwise("n1").alias("leader_id"))
    return replication.leader_safety(leaders)


@query
def raft_log_mismatches(spark, sf_dir):
    return replication.log_mismatches(I.raft_log(spark, sf_dir))


@query
def node_urls(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", codec.node_url(F.concat(F.lit("node"), F.col("s_suppkey").cast("string")), (F.col("s_suppkey") + 9000).cast("int")).alias("url"))


@query
def node_health(spark, sf_dir):
    beats = I.events(spark, sf_dir).select((F.col("user_id") % 20).alias("node_id"), F.col("e").alias("ts"))
    now = beats.agg(F.max("ts")).first()[0]
    return replication.healthy(beats, now, 15)


# ---------------------------------------------------------------- identity and audit


@query
def permission_effective(spark, sf_dir):
    return identity.effective(I.permission_events(spark, sf_dir), 50_000)


@query
def permission_check(spark, sf_dir):
    granted = identity.effective(I.permission_events(spark, sf_dir))
    users = table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("user_id"), (F.col("c_custkey") % 5 != 0).alias("active"))
    asked = F.explode(F.array(*map(F.lit, ("Read", "Write", "CreateUser", "RevokePermission", "ModifyClusterConfig"))))
    requests = table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("user_id"), asked.alias("wanted"))
    return identity.decisions(requests, users.filter("user_id <> 'u3'"), granted)


@query
def permission_sets(spark, sf_dir):
    """Each user's set in force, with one added and one removed, and merged with a preset."""
    held = identity.effective(I.permission_events(spark, sf_dir)).groupBy("user_id").agg(F.array_sort(F.collect_set("permission")).alias("held"))
    p, preset = F.col("held"), F.array(*map(F.lit, identity.PRESETS["read_write"]))
    names = lambda x: F.array_join(x, ",")
    return held.select("user_id", names(identity.with_permission(p, F.lit("Delete"))).alias("added"), names(identity.without_permission(p, F.lit("Read"))).alias("removed"), names(identity.merged(p, preset)).alias("merged"), identity.holds(p, F.lit("Read")).alias("exact"), identity.allows(p, F.lit("Read")).alias("implied"))


@query
def admin_grants(spark, sf_dir):
    """Changes of permissions that are for administrators only."""
    return I.permission_events(spark, sf_dir).filter(identity.is_admin_only(F.col("permission"))).select("event_id", "user_id", "permission", "action")


@query
def user_operations(spark, sf_dir):
    ops = I.events(spark, sf_dir).select(F.col("user_id").cast("string").alias("user_id"), F.col("e").alias("nonce"), "event_type")
    return identity.operations_of(ops, "7")


@query
def audit_trail(spark, sf_dir):
    return identity.audit_trail(I.permission_events(spark, sf_dir), "u7")


@query
def account_status(spark, sf_dir):
    e = I.events(spark, sf_dir)
    status = F.element_at(F.array(F.lit("Active"), F.lit("Suspended"), F.lit("Revoked")), (F.col("e") % 3 + 1).cast("int"))
    changes = e.select(F.col("e").alias("event_id"), (F.col("e") * 10).alias("ts"), F.col("user_id").cast("string").alias("user_id"), status.alias("status"), F.when(F.col("e") % 2 == 0, F.col("e") * 10 + 3000).alias("until"))
    return identity.status_at(changes, 60_000)


@query
def sessions_active(spark, sf_dir):
    s = I.events(spark, sf_dir).select(F.col("e").cast("string").alias("session_id"), F.col("user_id"), (F.col("e") * 10 + 3600).alias("expires_at"))
    ended = s.filter("CAST(session_id AS LONG) % 6 = 0")
    return identity.active_sessions(s, 50_000, ended)


@query
def session_users(spark, sf_dir):
    s = I.events(spark, sf_dir).select(F.col("e").cast("string").alias("session_id"), F.col("user_id").cast("string").alias("user_id"), (F.col("e") * 10 + 3600).alias("expires_at"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("user_id"), (F.col("c_custkey") % 5 != 0).alias("active"))
    return identity.session_users(s, users, 50_000)


@query
def lockout_streak(spark, sf_dir):
    return identity.failure_streaks(I.logins(spark, sf_dir))


@query
def locked_accounts(spark, sf_dir):
    return identity.locked(I.logins(spark, sf_dir), 3, 100_000, 60_000)


@query
def nonce_replay(spark, sf_dir):
    ops = I.events(spark, sf_dir).select("user_id", (F.col("e") % 50).alias("nonce"))
    return identity.replays(ops)


@query
def next_nonce(spark, sf_dir):
    return identity.next_nonce(I.events(spark, sf_dir).select("user_id", (F.col("e") % 50).alias("nonce")))


@query
def identity_chain(spark, sf_dir):
    return identity.identity_chain(I.identities(spark, sf_dir)).select("position", "user_id", hex_lower("identity_hash").alias("identity_hash"), hex_lower("chain_hash").alias("chain_hash"))


@query
def identity_chain_verify(spark, sf_dir):
    chain = identity.identity_chain(I.identities(spark, sf_dir))
    forged = chain.withColumn("creation_block", F.when(F.col("position") == 100, F.lit(99).cast("long")).otherwise(F.col("creation_block")))
    return identity.verify_identity_chain(forged)


@query
def temporal_permission(spark, sf_dir):
    e = I.events(spark, sf_dir)
    return e.select("event_id", identity.valid_at(F.col("e") - 10, F.when(F.col("e") % 4 != 0, F.col("e") + 10), F.lit(5000)).alias("valid"))


@query
def access_conditions(spark, sf_dir):
    """All conditions of an access hold: time, number of operations, address, second factor."""
    e = F.col("e")
    fields = lambda kind, low, high, listed: F.struct(F.lit(kind).alias("kind"), low.cast("long").alias("low"), high.cast("long").alias("high"), listed.alias("list"))
    none = F.array().cast("array<string>")
    conditions = F.array(fields("TimeRange", e - 5, e + F.col("user_id") % 7, none), fields("MaxOperations", F.lit(0), F.lit(8), none), fields("IPWhitelist", F.lit(0), F.lit(0), F.array(F.lit("10.0.0.1"), F.lit("10.0.0.2"))))
    ip = F.concat(F.lit("10.0.0."), (e % 3).cast("string"))
    return I.events(spark, sf_dir).select("event_id", identity.conditions_hold(conditions, e + 3, e % 10, ip, F.lit(False)).alias("allowed"))


@query
def living_records(spark, sf_dir):
    return _plain(scans.living(I.document_records(spark, sf_dir).select("key", (F.col("timestamp") * 1000).alias("timestamp")), 600_000, 300))


@query
def log_suffix(spark, sf_dir):
    return scans.entries_from(I.raft_log(spark, sf_dir), 90).select("node_id", "index", "term")


@query
def role_permissions(spark, sf_dir):
    roles = spark.createDataFrame([("reader", "Read"), ("writer", "Write"), ("writer", "Read"), ("root", "Admin")], "role string, permission string")
    own = I.events(spark, sf_dir).select(F.col("user_id"), F.element_at(F.array(F.lit("reader"), F.lit("writer"), F.lit("root")), (F.col("e") % 3 + 1).cast("int")).alias("role"))
    return identity.role_permissions(own, roles)
