"""Verification: one row for each block and check, all blocks at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import ZERO32, merkle_levels, proof_from_levels, proof_root
from .blocks import BATCH, block_index, grouped, recomputed

CHECKS = ("hash_ok", "root_ok", "link_ok", "count_ok", "records_ok")


def verify_chain(blocks: DataFrame, records: DataFrame, batch: int = BATCH, deep: bool = True) -> DataFrame:
    """(index, hash_ok, root_ok, link_ok, count_ok, records_ok) of each block but, in chain mode, the genesis.

    The link is an equi-join with the block before, so a block that is missing breaks its follower's link. Chain mode compares
    the stored record hashes only; deep mode also recomputes each of them, checks the genesis, and reports sealed records without a block.
    """
    own = recomputed(blocks, records, batch, deep)
    before = blocks.select((F.col("index") + 1).alias("index"), F.col("hash").alias("before"))
    sure = lambda c: F.coalesce(c, F.lit(False))
    first = F.when(F.col("index") == 0, F.col("previous_hash") == F.lit(ZERO32)).otherwise(F.col("previous_hash") == F.col("before"))
    checked = own.join(before, "index", "left").select(
        "index",
        sure(F.col("hash") == F.col("true_hash")).alias("hash_ok"),
        sure(F.col("merkle_root") == F.coalesce("true_root", F.lit(ZERO32))).alias("root_ok"),
        sure(first).alias("link_ok"),
        sure(F.col("n_records") == F.coalesce("true_n", F.lit(0))).alias("count_ok"),
        (F.col("hash").isNotNull() & (F.coalesce("wrong", F.lit(0)) == 0)).alias("records_ok"),
    )
    return checked if deep else checked.filter("index > 0")


def is_valid(checks: DataFrame) -> DataFrame:
    """One row: whether all checks of all blocks hold; true without blocks."""
    every = F.lit(True)
    for c in CHECKS:
        every = every & F.col(c)
    return checks.agg(F.coalesce(F.bool_and(every), F.lit(True)).alias("valid"), F.count("*").alias("blocks"))


def tip_matches(blocks: DataFrame, height: int, tip: bytes) -> DataFrame:
    """Whether the chain ends where a trusted note says; a chain that lost its tail is consistent in itself."""
    last = blocks.agg(F.max_by("hash", "index").alias("tip"), F.max("index").alias("height"))
    return last.select(((F.col("height") == height) & (F.col("tip") == F.lit(tip))).alias("valid"))


def block_at(blocks: DataFrame, index: int) -> DataFrame:
    """The block of an index, or no row."""
    return blocks.filter(F.col("index") == index)


def tip(blocks: DataFrame) -> DataFrame:
    """One row: the last block, and the chain's length with the genesis."""
    last = blocks.agg(F.max_by(F.struct(*blocks.columns), "index").alias("b"), F.count("*").alias("length"))
    return last.select("b.*", "length")


def all_valid(checks: DataFrame, identity_checks: DataFrame) -> DataFrame:
    """One row: whether the data's chain and the identities' chain both hold."""
    data = is_valid(checks).select(F.col("valid").alias("chain_valid"))
    people = identity_checks.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("identities_valid"))
    return data.crossJoin(F.broadcast(people)).withColumn("valid", F.col("chain_valid") & F.col("identities_valid"))


def proofs(wanted: DataFrame, records: DataFrame, batch: int = BATCH) -> DataFrame:
    """For the hashes wanted: index, place in the block, number of leaves, proof, and root. Records of blocks that aren't full are not sealed."""
    asked = records.join(wanted.select("hash"), "hash", "left_semi").select("hash", "sequence_number", block_index(batch).cast("long").alias("index"))
    asked = asked.groupBy("index").agg(F.collect_list(F.struct("hash", "sequence_number")).alias("asked"))  # at most `batch`
    groups = grouped(records, batch).filter(F.col("n_records") == batch)
    trees = groups.join(asked, "index").withColumn("levels", F.array(merkle_levels("hashes")))

    def answer(levels: Column) -> Column:
        place = lambda a: (a["sequence_number"] - F.col("first_sequence")).cast("int")
        return F.transform("asked", lambda a: F.struct(a["hash"].alias("hash"), place(a).alias("place"), proof_from_levels(levels, place(a)).alias("proof")))

    # A block's tree is hashed once: inside the lambda it is a value.
    found = trees.select("index", "n_records", "merkle_root", F.explode(F.flatten(F.transform("levels", answer))).alias("p"))
    return found.select("p.hash", "index", "p.place", F.col("n_records").alias("leaves"), "p.proof", "merkle_root")


def verify_proofs(found: DataFrame) -> DataFrame:
    return found.withColumn("proved", F.coalesce(proof_root("hash", "place", "leaves", "proof") == F.col("merkle_root"), F.lit(False)))
