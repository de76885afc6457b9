"""Replicated logs as tables: what is committed, who may be voted for, and whether the logs are safe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Invalid
from ..functions.codec import majority
from .ingest import accepted

#: Voters that are broadcast; a larger cluster is a mistake.
NODES = 10_000


def last_entries(log: DataFrame) -> DataFrame:
    """(node_id, last_index, last_term) of each node."""
    return log.groupBy("node_id").agg(F.max("index").alias("last_index"), F.max_by("term", "index").alias("last_term"))


def commit_index(match: DataFrame, log: DataFrame, current_term: int) -> DataFrame:
    """match: (node_id, match_index) of all nodes. The highest index that a majority has and whose entry is of the current term; 0 if none."""
    spread = match.agg(F.sort_array(F.collect_list("match_index"), asc=False).alias("m"))
    quorum = spread.select(F.get("m", (majority(F.size("m")) - 1).cast("int")).alias("quorum_index"))
    own = log.filter(F.col("term") == current_term).select("index").distinct()
    return quorum.join(own, F.col("index") <= F.col("quorum_index"), "left").agg(F.coalesce(F.max("index"), F.lit(0)).alias("commit_index"))


def commit_indexes(match: DataFrame, log: DataFrame) -> DataFrame:
    """(term, commit_index) for every term of the log, as `commit_index` gives it for one, in one pass over the log."""
    spread = match.agg(F.sort_array(F.collect_list("match_index"), asc=False).alias("m"))  # a cluster has few nodes
    quorum = spread.select(F.get("m", (majority(F.size("m")) - 1).cast("int")).alias("quorum_index"))
    known = F.when(F.col("index") <= F.col("quorum_index"), F.col("index"))
    return log.crossJoin(F.broadcast(quorum)).groupBy("term").agg(F.coalesce(F.max(known), F.lit(0)).alias("commit_index"))


def votes(requests: DataFrame, voters: DataFrame) -> DataFrame:
    """requests: (term, candidate, last_index, last_term); voters: (node_id, current_term, voted_for, last_index, last_term). Adds granted."""
    v = voters.select("node_id", "current_term", "voted_for", F.col("last_index").alias("own_index"), F.col("last_term").alias("own_term"))
    if (n := v.count()) > NODES:
        raise Invalid(f"{n} voters; a cluster has at most {NODES}")
    rows = requests.crossJoin(F.broadcast(v))
    newer = F.struct(F.col("last_term"), F.col("last_index")) >= F.struct(F.col("own_term"), F.col("own_index"))
    free = F.col("voted_for").isNull() | (F.col("voted_for") == F.col("candidate")) | (F.col("term") > F.col("current_term"))
    return rows.withColumn("granted", (F.col("term") >= F.col("current_term")) & free & newer)


def elected(granted: DataFrame, cluster_size: int) -> DataFrame:
    """(term, candidate, votes, won)."""
    return granted.groupBy("term", "candidate").agg(F.count_if("granted").alias("votes")).withColumn("won", F.col("votes") >= majority(F.lit(cluster_size)))


def unapplied(log: DataFrame, applied: int | Column, committed: int | Column) -> DataFrame:
    return log.filter((F.col("index") > applied) & (F.col("index") <= committed))


def applied(log: DataFrame, ledger: DataFrame | None, after: int | Column, committed: int | Column) -> DataFrame:
    """What the committed entries after `after` put into a ledger: of each new key the entry of least index."""
    puts = requires_consensus(unapplied(log, after, committed)).filter("kind = 'put'").select("key", "value", "index", "term")
    return accepted(puts, ledger, [F.col("index"), F.col("term")])


def requires_consensus(log: DataFrame) -> DataFrame:
    """Entries that change something; the others, 'noop', are read only."""
    return log.filter(F.lower("kind") != "noop")


def appended(log: DataFrame, entries: DataFrame, previous: int) -> DataFrame:
    """The log up to `previous`, then the entries; a gap before them is refused."""
    if previous > (log.agg(F.max("index")).first()[0] or 0):
        raise Invalid("the entries don't follow the log")
    return log.filter(F.col("index") <= previous).unionByName(entries)


def leader_safety(leaders: DataFrame) -> DataFrame:
    """Terms with more than one leader."""
    return leaders.groupBy("term").agg(F.count_distinct("leader_id").alias("leaders")).filter("leaders > 1")


def log_mismatches(log: DataFrame) -> DataFrame:
    """(index, term) where nodes hold different entries."""
    entry = F.sha2(F.concat_ws("|", "kind", F.hex("key"), F.hex("value")), 256)
    return log.groupBy("index", "term").agg(F.count_distinct(entry).alias("versions")).filter("versions > 1")


def incomplete_leaders(leaders: DataFrame, log: DataFrame, committed: DataFrame) -> DataFrame:
    """(term, leader_id, missing): leaders that lack entries committed in an earlier term, with how many.

    leaders: (term, leader_id); committed: (index, term) of the entries. Per earlier term the leader's entries are counted against the
    committed ones, so that no leader meets an entry: both are running sums over terms.
    """
    own = committed.join(log.select("index", "term", F.col("node_id").alias("leader_id")).distinct(), ["index", "term"]).groupBy("leader_id", "term").agg(F.count("*").alias("n"))
    every = committed.groupBy("term").agg(F.count("*").alias("n"))
    before = lambda rows, keys: rows.groupBy(*keys, F.col("for")).agg(F.sum("n").alias("n"))
    terms = leaders.select(F.col("term").alias("for"), "leader_id").distinct()
    # Terms are few beside entries: one row each on either side.
    wanted = before(terms.join(every, F.col("term") < F.col("for")), ["leader_id"])
    held = before(terms.join(own, (own["leader_id"] == terms["leader_id"]) & (F.col("term") < F.col("for"))).drop(own["leader_id"]), ["leader_id"]).withColumnRenamed("n", "held")
    missing = F.col("n") - F.coalesce("held", F.lit(0))
    return wanted.join(held, ["leader_id", "for"], "left").select(F.col("for").alias("term"), "leader_id", missing.alias("missing")).filter("missing > 0")


def leader(states: DataFrame) -> DataFrame:
    """The leader of the highest term that has one; of several, the last that said so."""
    return states.filter("state = 'Leader'").agg(F.max_by("node_id", F.struct("term", "ts", "seq")).alias("leader_id"), F.max("term").alias("term"))


def state_changes(states: DataFrame) -> DataFrame:
    """Illegal role changes of a node: terms that go back, or a leader that hasn't been a candidate."""
    own = Window.partitionBy("node_id").orderBy("ts", "seq")
    rows = states.withColumns({"before": F.lag("state").over(own), "term_before": F.lag("term").over(own)})
    return rows.filter((F.col("term") < F.col("term_before")) | ((F.col("state") == "Leader") & ~F.col("before").isin("Candidate", "Leader")))


def healthy(heartbeats: DataFrame, now: int, timeout_ms: int) -> DataFrame:
    """Nodes and whether their last heartbeat is recent enough."""
    return heartbeats.groupBy("node_id").agg(F.max("ts").alias("last_seen")).withColumn("healthy", F.lit(now) - F.col("last_seen") <= timeout_ms)
