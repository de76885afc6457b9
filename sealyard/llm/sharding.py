"""Shards by descending a weighted tree of regions, racks and shards. DataFrame functions only.

At each level every child draws -ln(u) / weight, u being the hash of the key and of the child's path, and the
smallest draw wins: a child gets rows in proportion to its weight, and when one weight grows, rows move only into
that child. A subtree whose weights stay the same keeps the order of its rows.

The key alone decides, so null, empty, equal or very long texts and repeated rows need no care: equal keys go
together. A null key is hashed as the text 'null'. Extra columns pass through `assign_shards`.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import md5_unit, ranked

LEVELS = ("region", "rack", "shard")
#: Sorted separately while slots are dealt; a rank inside one shard needs no task larger than shard / SLOT_BUCKETS.
SLOT_BUCKETS = 1024

Tree = Mapping[str, Mapping[str, Mapping[int, float]]]


def even_tree(shards: int, regions: int = 2, racks: int = 2) -> dict[str, dict[str, dict[int, float]]]:
    """Shards of weight 1, dealt evenly and in order to the racks of the regions."""
    tree: dict[str, dict[str, dict[int, float]]] = {}
    for s in range(shards):
        k = s * regions * racks // shards
        tree.setdefault(f"region{k // racks}", {}).setdefault(f"rack{k % racks}", {})[s] = 1.0
    return tree


def with_shard(tree: Tree, shard: int, weight: float = 1.0) -> dict:
    """One more shard in a region and a rack of its own: no other subtree's weight changes, so rows move only into it."""
    return {**tree, f"region_of_{shard}": {f"rack_of_{shard}": {shard: weight}}}


def _children(tree: Tree) -> dict[str, list[dict]]:
    """Each inner node's path, with its children and the weight of all below them."""
    total = lambda node: sum(map(total, node.values())) if isinstance(node, Mapping) else float(node)
    found: dict[str, list[dict]] = {}

    def walk(path: str, node) -> None:
        found[path] = [{"path": f"{path}/{k}", "weight": total(v)} for k, v in node.items() if total(v) > 0]
        for k, v in node.items():
            if isinstance(v, Mapping):
                walk(f"{path}/{k}", v)

    walk("", tree)
    return found


def leaf(key: Column, tree: Tree) -> Column:
    """The shard that a key descends to."""
    nodes = F.from_json(F.lit(json.dumps(_children(tree))), "map<string,array<struct<path:string,weight:double>>>")
    key = F.coalesce(key.cast("string"), F.lit("null"))
    path = F.lit("")
    for _ in LEVELS:
        draws = F.transform(F.element_at(nodes, path), lambda c: F.struct((-F.ln(md5_unit(key, c["path"])) / c["weight"]).alias("draw"), c["path"].alias("path")))
        path = F.array_min(draws)["path"]
    return F.element_at(F.split(path, "/"), -1).cast("int")


def assign_shards(df: DataFrame, key: str, tree: Tree, name: str = "shard") -> DataFrame:
    """Adds the shard of each row; an existing column of that name is replaced."""
    return df.withColumn(name, leaf(F.col(key), tree))


def with_slots(df: DataFrame, key: str, order: Sequence[str], shard: str = "shard", name: str = "slot", buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Numbers the rows of each shard from 0 without a gap, in the order of a hash of the key and then `order`."""
    bucket = F.floor(md5_unit(F.lit("slot"), F.coalesce(F.col(key).cast("string"), F.lit("null"))) * buckets)
    return ranked(df, [shard], bucket, [F.col(c).asc_nulls_last() for c in order], name)
