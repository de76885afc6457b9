"""Digests whose pre-images are fixed byte for byte, as Columns; Merkle roots and proofs as folds over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codec import _col, be8, le8, sha256

ZERO32 = bytes(32)
#: Levels of the folds below: enough for 2**LEVELS leaves.
LEVELS = 24


def record_hash(key, value, timestamp, sequence) -> Column:
    """SHA-256 of key, value, timestamp in ms and sequence number, both as 8 bytes big-endian; no lengths."""
    return sha256(F.concat(_col(key), _col(value), be8(timestamp), be8(sequence)))


def block_hash(index, timestamp, previous, root, nonce, record_hashes) -> Column:
    """record_hashes is the concatenation of the block's record hashes in order; timestamp is in seconds."""
    return sha256(F.concat(be8(index), be8(timestamp), _col(previous), _col(root), be8(nonce), _col(record_hashes)))


def concat_all(hashes) -> Column:
    return F.aggregate(_col(hashes), F.lit(b""), lambda a, h: F.concat(a, h))


def _level(h: Column) -> Column:
    """Parents of a level; an odd last node is its own sibling."""
    pairs = F.sequence(F.lit(0), F.ceil(F.size(h) / 2).cast("int") - 1)
    return F.transform(pairs, lambda i: sha256(F.concat(F.get(h, 2 * i), F.coalesce(F.get(h, 2 * i + 1), F.get(h, 2 * i)))))


def _levels(h: Column) -> Column:
    """One element for each level above the leaves."""
    n = F.greatest(F.size(h), F.lit(1))
    return F.when(n > 1, F.sequence(F.lit(1), F.ceil(F.log2(n)).cast("int"))).otherwise(F.array().cast("array<int>"))


def merkle_root(hashes) -> Column:
    """Root over the leaves' hashes: 32 zero bytes without a leaf, the leaf itself if it is alone."""
    h = _col(hashes)
    top = F.aggregate(_levels(h), h, lambda acc, _: _level(acc))
    return F.coalesce(F.get(top, F.lit(0)), F.lit(ZERO32))


def merkle_levels(hashes) -> Column:
    """The tree's levels, leaves first."""
    h = _col(hashes)
    start = F.struct(h.alias("h"), F.array(h).alias("all"))

    def step(s: Column, _: Column) -> Column:
        above = _level(s["h"])
        return F.struct(above.alias("h"), F.concat(s["all"], F.array(above)).alias("all"))

    return F.aggregate(_levels(h), start, step, lambda s: s["all"])


def proof_from_levels(levels, at) -> Column:
    """As `merkle_proof`, from a tree whose levels are known: for many leaves of one block they are hashed once."""

    def sibling(k: Column) -> Column:
        place = F.floor(_col(at) / F.pow(F.lit(2), k)).cast("int")
        left = place % 2 == 1
        return F.struct(F.get(F.get(_col(levels), k), F.when(left, place - 1).otherwise(place + 1)).alias("sibling"), left.alias("is_left"))

    below = F.when(F.size(_col(levels)) > 1, F.sequence(F.lit(0), F.size(_col(levels)) - 2)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(below, sibling), lambda p: p["sibling"].isNotNull())


def merkle_proof(hashes, at) -> Column:
    """Siblings from the leaf at a place (from 0) upwards, each with whether it stands left; an odd last node gives none."""
    h, place = _col(hashes), _col(at).cast("int")
    none = F.array().cast("array<struct<sibling:binary,is_left:boolean>>")
    start = F.struct(h.alias("h"), place.alias("i"), none.alias("proof"))

    def step(s: Column, _: Column) -> Column:
        left = s["i"] % 2 == 1
        sibling = F.get(s["h"], F.when(left, s["i"] - 1).otherwise(s["i"] + 1))
        more = F.when(sibling.isNotNull(), F.concat(s["proof"], F.array(F.struct(sibling.alias("sibling"), left.alias("is_left"))))).otherwise(s["proof"])
        return F.struct(_level(s["h"]).alias("h"), F.floor(s["i"] / 2).cast("int").alias("i"), more.alias("proof"))

    return F.aggregate(_levels(h), start, step, lambda s: s["proof"])


def proof_root(leaf, at, leaves, proof) -> Column:
    """The root that a proof leads to. The leaf's place and the number of leaves say where a node is its own sibling."""
    start = F.struct(_col(leaf).alias("h"), _col(at).cast("int").alias("i"), _col(leaves).cast("int").alias("n"), F.lit(0).alias("used"))
    up = F.when(_col(leaves) > 1, F.sequence(F.lit(1), F.ceil(F.log2(F.greatest(_col(leaves), F.lit(1)))).cast("int"))).otherwise(F.array().cast("array<int>"))

    def step(s: Column, _: Column) -> Column:
        alone = (s["i"] % 2 == 0) & (s["i"] + 1 == s["n"])
        p = F.get(_col(proof), s["used"])
        h = F.when(alone, sha256(F.concat(s["h"], s["h"]))).when(s["i"] % 2 == 1, sha256(F.concat(p["sibling"], s["h"]))).otherwise(sha256(F.concat(s["h"], p["sibling"])))
        return F.struct(h.alias("h"), F.floor(s["i"] / 2).cast("int").alias("i"), F.ceil(s["n"] / 2).cast("int").alias("n"), F.when(alone, s["used"]).otherwise(s["used"] + 1).alias("used"))

    whole = lambda s: F.when(s["used"] == F.size(_col(proof)), s["h"])  # noqa: E731  a proof with more steps proves nothing
    return F.aggregate(up, start, step, whole)


def identity_hash(user, public_key, creation_block, creation_timestamp, permissions_root) -> Column:
    """Little-endian numbers here."""
    return sha256(F.concat(_col(user).cast("binary"), _col(public_key), le8(creation_block), le8(creation_timestamp), _col(permissions_root)))


def permissions_root(permissions) -> Column:
    """One digest of the sorted names: not a tree."""
    return sha256(F.array_join(F.array_sort(_col(permissions)), ""))


def operation_hash(kind, key, value, user, nonce, timestamp) -> Column:
    """PUT, GET or DELETE, key, value if PUT, user, and nonce and timestamp as little-endian numbers."""
    head = F.upper(_col(kind)).cast("binary")
    body = F.when(F.lower(_col(kind)) == "put", F.coalesce(_col(value), F.lit(b""))).otherwise(F.lit(b""))
    return sha256(F.concat(head, _col(key), body, _col(user).cast("binary"), le8(nonce), le8(timestamp)))


def password_hash(password, salt) -> Column:
    """Plain salted SHA-256, for compatibility; new systems need a slow key derivation."""
    return sha256(F.concat(_col(password).cast("binary"), _col(salt)))
