"""Locks as tables: who may be granted, who waits in vain, who waits in a circle."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grantable(requests: DataFrame, held: DataFrame) -> DataFrame:
    """Adds granted to each request (key, tx_id, mode): shared locks go together, exclusive ones alone; a transaction
    gets again what it holds, and may raise its shared lock if no other holds one."""
    state = held.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("mode") == "exclusive").alias("exclusive"))
    mine = held.groupBy("key", "tx_id").agg(F.max(F.when(F.col("mode") == "exclusive", 2).otherwise(1)).alias("own"), F.count("*").alias("own_n"))
    rows = requests.join(state, "key", "left").join(mine, ["key", "tx_id"], "left")
    shared, sole = F.col("mode") == "shared", F.coalesce("n", F.lit(0)) == F.coalesce("own_n", F.lit(0))
    granted = F.when(F.col("own") == 2, True).when(shared & F.col("own").isNotNull(), True).when(shared, F.coalesce("exclusive", F.lit(0)) == 0).otherwise(sole)
    return rows.select("key", "tx_id", "mode", granted.alias("granted"))


def granted_prefix(waits: DataFrame) -> DataFrame:
    """Of each key's queue, once the key is free, the head that can be granted together: one exclusive, or all shared ones before the first exclusive."""
    # The head and the first exclusive request of each queue, by partial aggregation: no task sorts a hot key's queue.
    at, exclusive = F.struct("requested_at", "tx_id"), F.col("mode") == "exclusive"
    ends = waits.groupBy("key").agg(F.min(at).alias("head"), F.min(F.when(exclusive, at)).alias("bar"))
    granted = F.when(exclusive, at == F.col("head")).otherwise(F.col("bar").isNull() | (at < F.col("bar")))
    return waits.join(ends, "key").withColumn("granted", granted).drop("head", "bar")


def waits_for(waiting: DataFrame, held: DataFrame) -> DataFrame:
    """(tx_id, blocker) edges: a waiter of a key and each other holder of it."""
    return waiting.select("key", "tx_id").join(held.select("key", F.col("tx_id").alias("blocker")), "key").filter("tx_id <> blocker").select("tx_id", "blocker").distinct()


def released(held: DataFrame, releases: DataFrame) -> DataFrame:
    """The locks that are still held after (key, tx_id) pairs are released; a release without a key frees all of its transaction's."""
    whole = releases.filter("key IS NULL").select("tx_id").distinct()
    return held.join(releases.filter("key IS NOT NULL").select("key", "tx_id").distinct(), ["key", "tx_id"], "left_anti").join(whole, "tx_id", "left_anti").select(*held.columns)


#: Edges whose circles one task finds; more are first dealt by their components.
SMALL = 1_000_000
#: Edges of whole components that a task searches at once.
TOGETHER = 100_000
#: Tasks that components are dealt to, at least.
DEALT = 64


def _circles(edges: list[tuple]) -> list:
    """Nodes on a circle: those in a strongly connected part of two or more, by one depth-first search without recursion."""
    after: dict = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    order: dict = {}
    low: dict = {}
    stack, inside, found = [], set(), []
    for root in after:
        if root in order:
            continue
        path = [(root, iter(after[root]))]
        order[root] = low[root] = len(order)
        stack.append(root)
        inside.add(root)
        while path:
            node, rest = path[-1]
            for other in rest:
                if other not in order:
                    order[other] = low[other] = len(order)
                    stack.append(other)
                    inside.add(other)
                    path.append((other, iter(after[other])))
                    break
                if other in inside:
                    low[node] = min(low[node], order[other])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == order[node]:
                    part = []
                    while not part or part[-1] != node:
                        part.append(stack.pop())
                    inside.difference_update(part)
                    if len(part) > 1:
                        found += part
    return found


def deadlocked(edges: DataFrame, checkpoint=None, small: int = SMALL) -> DataFrame:
    """Transactions on a circle of waits. checkpoint(df) writes a table in between.

    At most `small` edges are searched by one task. Of more, components are found first, as no circle leaves its own: those of at most `small` edges
    are dealt to tasks, which search some whole ones at a time. What is left, a component of more than `small` edges, goes through `_labelled`.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    keep = checkpoint or (lambda df: df.checkpoint(eager=True))
    waits = edges.filter("tx_id <> blocker").select("tx_id", "blocker")
    left, found, kind = keep(waits.distinct()), None, edges.schema["tx_id"].dataType
    arrow, schema = to_arrow_type(kind), f"tx_id {kind.simpleString()}"

    def circles(pairs: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(_circles(pairs), arrow)], names=["tx_id"])

    def search(batches):
        yield circles([pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)])

    def search_each(batches):
        pairs, last = [], None
        for batch in batches:
            for a, b, component in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if component != last and len(pairs) >= TOGETHER:
                    yield circles(pairs)
                    pairs = []
                last = component
                pairs.append((a, b))
        yield circles(pairs)

    if (total := left.count()) > small:
        from ..llm.common import components  # numpy inside tasks

        # From the edges as they come: a task reduces those that are near each other to few.
        label = keep(components(waits.select(F.col("tx_id").alias("a"), F.col("blocker").alias("b")), small))
        placed = keep(left.join(label.withColumnRenamed("node", "tx_id"), "tx_id").select("tx_id", "blocker", "component"))
        big = F.broadcast(keep(placed.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > small).select("component")))  # less than total / small
        dealt = placed.join(big, "component", "left_anti").select("tx_id", "blocker", "component")
        found = dealt.repartition(max(DEALT, total // small + 1), "component").sortWithinPartitions("component").mapInArrow(search_each, schema)
        left, more = _labelled(keep(placed.join(big, "component", "left_semi").select("tx_id", "blocker")), keep, small)
        found = found if more is None else found.unionByName(more)
    rest = left.coalesce(1).mapInArrow(search, schema)
    return rest if found is None else found.unionByName(rest)


def _labelled(left: DataFrame, keep, small: int) -> tuple[DataFrame, DataFrame | None]:
    """At most `small` of these edges, with all circles that aren't found yet, and the nodes of those that are.

    The edges lose, round by round, those that wait for none or that none waits for. If too many are left,
    every node takes the smallest id that leads to it along edges; what leads back to that id among nodes of its label is its circle. Both are labels, one
    a node, passed along edges until nothing changes; the circles found go, and the rest is searched again. There are as many rounds as the longest way has steps.
    """
    found, n = None, -1
    while (now := left.count()) > small:
        if now != n:
            n = now
            left = keep(left.join(left.select(F.col("tx_id").alias("blocker")).distinct(), "blocker", "left_semi").join(left.select(F.col("blocker").alias("tx_id")).distinct(), "tx_id", "left_semi").select("tx_id", "blocker"))
            continue
        label = keep(left.select(F.col("tx_id").alias("node")).union(left.select("blocker")).distinct().withColumn("label", F.col("node")))
        while True:
            told = left.join(label, left["tx_id"] == label["node"]).groupBy("blocker").agg(F.min("label").alias("told"))
            after = keep(label.join(told, label["node"] == told["blocker"], "left").select("node", F.least("label", F.coalesce("told", "label")).alias("label"), (F.col("told") < F.col("label")).alias("changed")))
            changed = after.filter("changed").limit(1).count()
            label = after.select("node", "label")
            if not changed:
                break
        # Edges inside a label, read backwards from the node that gave it.
        inner = left.join(label.select(F.col("node").alias("tx_id"), "label"), "tx_id").join(label.select(F.col("node").alias("blocker"), F.col("label").alias("other")), "blocker").filter("label = other").select("tx_id", "blocker")
        inner, back = keep(inner), keep(label.filter("node = label").select("node"))
        while True:
            more = inner.join(back.withColumnRenamed("node", "blocker"), "blocker", "left_semi").select(F.col("tx_id").alias("node")).distinct().join(back, "node", "left_anti")
            more = keep(more)
            if not more.limit(1).count():
                break
            back = keep(back.unionByName(more))
        # A label's own node is on a circle if something inside leads back to it.
        own = back.join(label, "node").groupBy("label").agg(F.count("*").alias("n")).filter("n > 1").select("label")
        part = keep(back.join(label, "node").join(own, "label", "left_semi").select(F.col("node").alias("tx_id")))
        found = part if found is None else found.unionByName(part)
        left = keep(left.join(back.withColumnRenamed("node", "tx_id"), "tx_id", "left_anti").join(back.withColumnRenamed("node", "blocker"), "blocker", "left_anti").select("tx_id", "blocker"))
        n = -1
    return left, found
