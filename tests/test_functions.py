"""Encodings and digests against hashlib, base64 and bytes."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from sealyard.functions import codec, hashing

ODD = [b"", b"\x00", b"\xff\xfe", "héé🙂".encode(), b"\xc3\xa9" * 40, bytes(range(256))]


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


@pytest.mark.parametrize("x", [0, 1, 255, 256, 1 << 40, (1 << 63) - 1])
def test_integers(spark, x):
    r = one(spark, codec.be8(F.lit(x).cast("long")), codec.le8(F.lit(x).cast("long")))
    assert bytes(r[0]) == x.to_bytes(8, "big") and bytes(r[1]) == x.to_bytes(8, "little")


@pytest.mark.parametrize("data", ODD)
def test_bytes(spark, data):
    d = F.lit(data)
    r = one(spark, codec.to_base64(d), codec.from_base64(codec.to_base64(d)), codec.lossy_utf8(d), codec.sha256(d))
    assert r[0] == base64.b64encode(data).decode() and bytes(r[1]) == data and bytes(r[3]) == hashlib.sha256(data).digest()
    assert r[2].replace("�", "") == data.decode("utf-8", "replace").replace("�", "")


def test_bad_base64_is_null(spark):
    assert one(spark, codec.decode_field(F.lit("***"), F.lit("base64")))[0] is None


@pytest.mark.parametrize("prefix,above", [(b"a", b"b"), (b"a\xff", b"b"), (b"\xff\xff", None), (b"", None), (b"ab\x00", b"ab\x01")])
def test_successor(prefix, above):
    assert codec.successor(prefix) == above


def tree_root(leaves):
    if not leaves:
        return bytes(32)
    while len(leaves) > 1:
        leaves = [hashlib.sha256(leaves[i] + (leaves[i + 1] if i + 1 < len(leaves) else leaves[i])).digest() for i in range(0, len(leaves), 2)]
    return leaves[0]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 7, 8, 9, 31, 33, 100])
def test_merkle_root_and_proofs(spark, n):
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
    df = spark.createDataFrame([(leaves, i) for i in range(max(n, 1))], "h array<binary>, i int")
    rows = df.select(hashing.merkle_root("h").alias("root"), hashing.merkle_proof("h", "i").alias("proof"), "h", "i").select("root", hashing.proof_root(F.get("h", F.col("i")), "i", F.size("h"), "proof").alias("back")).collect()
    for r in rows:
        assert bytes(r.root) == tree_root(leaves)
        assert n == 0 or bytes(r.back) == bytes(r.root)


def test_proof_of_another_leaf_fails(spark):
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(6)]
    df = spark.createDataFrame([(leaves,)], "h array<binary>").withColumn("p", hashing.merkle_proof("h", F.lit(2)))
    r = df.select(hashing.proof_root(F.lit(leaves[3]), F.lit(2), F.lit(6), "p").alias("other"), hashing.proof_root(F.lit(leaves[2]), F.lit(3), F.lit(6), "p").alias("place"), hashing.merkle_root("h").alias("root")).first()
    assert r.other != r.root and r.place != r.root


def test_record_and_operation_hash(spark):
    r = one(spark, hashing.record_hash(F.lit(b"k"), F.lit(b""), F.lit(5), F.lit(7)), hashing.operation_hash(F.lit("put"), F.lit(b"k"), F.lit(b"v"), F.lit("u"), F.lit(1), F.lit(2)))
    assert bytes(r[0]) == hashlib.sha256(b"k" + (5).to_bytes(8, "big") + (7).to_bytes(8, "big")).digest()
    assert bytes(r[1]) == hashlib.sha256(b"PUTkvu" + (1).to_bytes(8, "little") + (2).to_bytes(8, "little")).digest()


@pytest.mark.parametrize("word,ok", [("Abcdef1!", True), ("abcdef1!", False), ("ABCDEF1!", False), ("Abcdefg!", False), ("Abcdefg1", False), ("Ab1!", False), ("", False)])
def test_password_policy(spark, word, ok):
    assert one(spark, codec.password_ok(F.lit(word)))[0] is ok
