"""First writer wins, restarts, races, sealing, tampering, compaction, collections and streams."""

import hashlib
import uuid
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sealyard.collections import Collections
from sealyard.errors import AppendOnly, Conflict, DuplicateKey, Invalid, NotFound
from sealyard.ledger import Ledger
from sealyard.operators import blocks, chains, identity, ingest, verify
from sealyard.operators.ordering import numbered
from sealyard.operators.validation import Field, Index, Schema
from sealyard.schemas import BLOCK
from sealyard.streaming.ingest import append_stream

PUT = "key binary, value binary, timestamp long"


def puts(spark, rows):
    return spark.createDataFrame([(bytearray(k), bytearray(v), t) for k, v, t in rows], PUT)


def many(spark, n, start=0):
    return spark.range(start, start + n).select(F.format_string("key_%05d", "id").cast("binary").alias("key"), F.concat(F.lit("v"), F.col("id").cast("string")).cast("binary").alias("value"), (F.col("id") * 10).alias("timestamp"))


def test_first_writer_wins(spark, tmp_path):
    led = Ledger(spark, str(tmp_path / "l"))
    assert led.append(puts(spark, [(b"key1", b"a", 1), (b"key2", b"b", 2), (b"key1", b"c", 3), (b"key3", b"d", 4), (b"key2", b"e", 5)])) == 3
    assert led.get(b"key1") == b"a" and led.get(b"none") is None and led.exists(b"key3")
    with pytest.raises(DuplicateKey):
        led.put(b"key1", b"x", 9)
    with pytest.raises(AppendOnly):
        led.delete(b"key1")
    assert led.get(b"key1") == b"a"
    status = {(bytes(r.key), r.status) for r in led.with_status(puts(spark, [(b"key1", b"z", 1), (b"new", b"z", 2), (b"new", b"y", 3)])).collect()}
    assert status == {(b"key1", "duplicate_key"), (b"new", "accepted"), (b"new", "duplicate_in_batch")}


@pytest.mark.parametrize("key,value", [(b"", b""), (b"\x00a\x00", b"\x00"), ("🙂".encode(), b"x"), (b"k" * 65536, b"v"), (b"big", b"x" * 1_000_000)])
def test_edge_bytes(spark, tmp_path, key, value):
    led = Ledger(spark, str(tmp_path / "l"), batch=1)
    led.put(key, value, 1)
    led.seal()
    assert led.get(key) == value and led.verify()


def test_restart_seal_and_stats(spark, tmp_path):
    path = str(tmp_path / "l")
    led = Ledger(spark, path, batch=7)
    led.append(many(spark, 30))
    assert led.seal() == 4 and led.verify()
    led = Ledger(spark, path, batch=7)
    assert led.append(many(spark, 30, 20)) == 20  # ten are known
    assert led.seal() == 3 and led.verify()
    s = led.stats()
    assert (s["records"], s["height"], s["pending"], s["sequence"]) == (50, 7, 1, 50)
    assert [r.sequence_number for r in led.records().orderBy("key").collect()] == list(range(1, 51))
    assert led.seal(force=True) == 1 and led.verify()
    led.reset()
    assert led.get(b"key_00001") is None and led.verify()
    assert led.append(many(spark, 3)) == 3 and led.verify()


def test_two_writers(spark, tmp_path):
    led = Ledger(spark, str(tmp_path / "l"))
    base = led.store.manifest()
    led.put(b"same", b"1", 1)
    with pytest.raises(Conflict):
        led.store.commit(base, sequence=1)
    assert led.get(b"same") == b"1"


def chain(spark, batch=5, n=23):
    r = ingest.records(many(spark, n), "timestamp").cache()
    first = blocks.genesis(spark)
    return first.unionByName(blocks.seal(r, bytes(first.first().hash), batch)).cache(), r


def broken(spark, b, r, **kw):
    return {c for row in verify.verify_chain(b, r, 5, **kw).collect() for c in verify.CHECKS if not row[c]}


def test_tamper_matrix(spark):
    b, r = chain(spark)
    assert broken(spark, b, r) == set() and broken(spark, b, r, deep=False) == set()
    at = F.col("sequence_number") == 8
    swap = lambda c, v: r.withColumn(c, F.when(at, v).otherwise(F.col(c)))
    for c, v in (("key", F.lit(b"x")), ("value", F.lit(b"x")), ("timestamp", F.lit(3).cast("long"))):
        assert broken(spark, b, swap(c, v)) >= {"records_ok"}
        assert "records_ok" not in broken(spark, b, swap(c, v), deep=False)
    assert broken(spark, b, swap("hash", F.lit(bytes(32)))) >= {"root_ok", "hash_ok", "records_ok"}
    assert broken(spark, b, r.filter(~at)) >= {"root_ok", "count_ok"}
    two = F.col("index") == 2
    for c, v in (("previous_hash", F.lit(bytes(32))), ("merkle_root", F.lit(bytes(32))), ("hash", F.lit(bytes(32))), ("nonce", F.lit(1).cast("long"))):
        assert broken(spark, b.withColumn(c, F.when(two, v).otherwise(F.col(c))), r)
    assert "link_ok" in broken(spark, b.filter(~two), r)
    assert broken(spark, b.withColumn("index", F.when(two, 9).otherwise(F.col("index")).cast("long")), r)
    # A chain that lost its end is consistent; a note of its tip tells.
    short = b.filter("index < 4")
    tip = b.filter("index = 4").first()
    assert not verify.tip_matches(short, 4, bytes(tip.hash)).first().valid and verify.tip_matches(b, 4, bytes(tip.hash)).first().valid
    assert "link_ok" in broken(spark, short, r) or broken(spark, short, r)  # its sealed records have no block


def test_a_chain_is_linked_part_by_part(spark, tmp_path):
    """Each link follows the one before across parts, and no task links more than a part."""
    first = blocks.genesis(spark).first()
    r = ingest.records(many(spark, 200), "timestamp").cache()
    groups = blocks.grouped(r, 10)
    sizes = tmp_path / "sizes"
    sizes.mkdir()

    def counted(batches, last):
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([last] * batch.num_rows, pa.binary())], names=["index", "tip"])
        (sizes / str(uuid.uuid4())).write_text(str(rows))

    plain = groups.select("index", F.lit(b"x").alias("hash"))
    assert chains.linked(plain, F.floor(F.col("index") / 3), "index", counted, StructType.fromDDL("index long, tip binary"), "tip", b"a").count() == 20
    assert sorted(int(f.read_text()) for f in sizes.iterdir()) == [2, 3, 3, 3, 3, 3, 3]

    last, want = bytes(first.hash), []
    for g in groups.orderBy("index").collect():
        last = hashlib.sha256(g["index"].to_bytes(8, "big") + g.timestamp.to_bytes(8, "big") + last + g.merkle_root + bytes(8) + b"".join(g.hashes)).digest()
        want.append((g["index"], last))
    for part in (1, 3, 7, 1000):
        got = blocks.chained(groups, bytes(first.hash), part)
        assert [(b["index"], bytes(b.hash)) for b in got.orderBy("index").collect()] == want
        assert verify.is_valid(verify.verify_chain(blocks.genesis(spark).unionByName(got), r, 10)).first().valid
    assert blocks.chained(groups.filter("false"), bytes(first.hash), 3).count() == 0


@pytest.mark.parametrize("part", [1, 4, 100])
def test_identities_are_linked_part_by_part(spark, part):
    """Positions have gaps, so parts are of places."""
    rows = [(k * k, f"u{k}", bytes([k]), k, k * 10, bytes(32)) for k in range(11)]
    df = spark.createDataFrame(rows, "position long, user_id string, public_key binary, creation_block long, creation_timestamp long, permissions_root binary").repartition(5)
    for previous in (None, b"tip"):
        last, want = previous, []
        for p, u, key, block, ts, root in rows:
            h = hashlib.sha256(u.encode() + key + block.to_bytes(8, "little") + ts.to_bytes(8, "little") + root).digest()
            last = h if last is None else hashlib.sha256(last + h).digest()
            want.append((p, h, last))
        got = identity.identity_chain(df, previous, part).orderBy("position").collect()
        assert [(g.position, bytes(g.identity_hash), bytes(g.chain_hash)) for g in got] == want


def test_order_of_input_doesnt_matter(spark):
    df = many(spark, 200)
    a = ingest.records(df, "timestamp").orderBy("key").collect()
    b = ingest.records(df.orderBy(F.rand(3)).repartition(7), "timestamp").orderBy("key").collect()
    assert a == b


@pytest.mark.parametrize("parts", [1, 3, 256])
def test_numbered(spark, parts):
    df = spark.createDataFrame([(5.0, "a"), (5.0, "b"), (1.0, "c"), (None, "d"), (9.5, "e")], "x double, y string")
    got = {r.y: r.n for r in numbered(df, "x", [F.col("y")], "n", 10, parts).collect()}
    assert got == {"d": 10, "c": 11, "a": 12, "b": 13, "e": 14}
    assert numbered(df.filter("false"), "x", name="n").count() == 0


def test_numbered_by_ties_of_one_value(spark):
    """Equal values of the first column are split by the others: no part holds all."""
    df = spark.range(5000).select(F.lit(7).alias("x"), F.sha2(F.col("id").cast("string"), 256).alias("y"))
    got = numbered(df, "x", [F.col("y")], "n", 1, 16).withColumn("part", F.spark_partition_id()).collect()
    assert [r.n for r in sorted(got, key=lambda r: r.y)] == list(range(1, 5001))
    assert max(Counter(r.part for r in got).values()) < 1500


def test_statuses_of_tied_rows(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1), ("c", 1)], "key string, at int")
    known = spark.createDataFrame([("c",)], "key string")
    got = Counter((r.key, r.status) for r in ingest.with_status(df, known, [F.col("at")]).collect())
    assert got == {("a", "accepted"): 1, ("a", "duplicate_in_batch"): 2, ("b", "accepted"): 1, ("c", "duplicate_key"): 1}


def test_compaction_keeps_records(spark, tmp_path):
    led = Ledger(spark, str(tmp_path / "l"), batch=4)
    for i in range(12):
        led.append(many(spark, 3, 3 * i))
    before = {bytes(r.key): r.sequence_number for r in led.records().collect()}
    led.compact()
    m = led.store.manifest()
    assert len(m["segments"]) == 1 and m["segments"][0]["level"] == 1
    assert {bytes(r.key): r.sequence_number for r in led.records().collect()} == before
    led.seal()
    assert led.verify() and len(led.store.vacuum()) == 12 and led.verify()


def test_scans(spark, tmp_path):
    led = Ledger(spark, str(tmp_path / "l"))
    led.append(puts(spark, [(b"a:1", b"1", 1), (b"a:2", b"2", 2), (b"a:\xff", b"3", 3), (b"b:1", b"4", 4)]))
    keys = lambda df: [bytes(r.key) for r in df.orderBy("key").collect()]
    assert keys(led.prefix(b"a:")) == [b"a:1", b"a:2", b"a:\xff"]
    assert keys(led.scan(b"a:2", b"b:1")) == [b"a:2", b"a:\xff"]
    assert bytes(led.latest_by_prefix(b"a:").first().key) == b"a:\xff"
    page = led.page(b"", 3, 0).collect()
    assert len(page) == 3 and page[0].total_count == 4 and page[0].has_more
    assert "PushedFilters: [IsNotNull(key)" in (led.prefix(b"a:")._jdf.queryExecution().toString())


def test_collections(spark, tmp_path):
    cols = Collections(spark, str(tmp_path / "c"), batch=5)
    schema = Schema({"name": Field("String", True, None, {"MinLength": 1, "MaxLength": 10}), "email": Field("String", True, None, {"Pattern": "^[^@]+@[^@]+$"})})
    users, orders = cols.create("users", "people", schema=schema), cols.create("orders")
    with pytest.raises(Invalid):
        cols.create("users")
    users.create_index(Index("by_email", ["email"], unique=True))
    doc = lambda name, mail: f'{{"name": "{name}", "email": "{mail}"}}'.encode()
    assert users.append(puts(spark, [(b"k", doc("Al", "al@x"), 1), (b"k2", doc("Bo", "bo@x"), 2)])) == 2
    for bad in (b"{'name': 1}", doc("", "a@b"), doc("Al", "nomail"), b'{"name": "x"}', doc("Cy", "al@x")):
        with pytest.raises(Invalid):
            cols.get("users").append(puts(spark, [(b"k9", bad, 3)]))
    with pytest.raises(Invalid):  # twice in one batch
        users.append(puts(spark, [(b"k7", doc("Cy", "cy@x"), 3), (b"k8", doc("Di", "cy@x"), 4)]))
    # A key that is there is left out, so the value that it would have had counts for nothing.
    assert users.append(puts(spark, [(b"k", doc("Al", "bo@x"), 5), (b"k3", doc("Ed", "ed@x"), 6)])) == 1
    assert orders.append(puts(spark, [(b"k", b"anything", 1)])) == 1  # the same key elsewhere
    assert users.ledger.get(b"k") != orders.ledger.get(b"k")
    assert cols.get("users").index("by_email").filter("email = 'bo@x'").first().key == b"k2"
    assert cols.verify() == {"users": True, "orders": True}
    small = cols.create("small", settings={"max_document_size": 4, "ttl_seconds": 10})
    with pytest.raises(Invalid):
        small.append(puts(spark, [(b"k", b"12345", 1)]))
    assert small.append(puts(spark, [(b"k", b"1234", 1000), (b"l", b"1", 9000)])) == 2
    assert [r.key for r in cols.get("small").documents(12_000).collect()] == [b"l"]
    cols.drop("small")
    users.drop_index("by_email")
    with pytest.raises(NotFound):
        cols.get("users").index("by_email")
    cols.drop("orders")
    assert Collections(spark, str(tmp_path / "c")).names() == ["users"]
    with pytest.raises(NotFound):
        cols.get("orders")


def test_stream_equals_batch(spark, tmp_path):
    src, df = str(tmp_path / "in"), many(spark, 60)
    for part in range(3):
        df.filter(F.col("timestamp") % 30 <= 10 * part).repartition(1).write.mode("append").parquet(src)
    led = Ledger(spark, str(tmp_path / "l"), batch=10)
    stream = lambda: spark.readStream.schema(PUT).option("maxFilesPerTrigger", 1).parquet(src)
    append_stream(stream(), led, str(tmp_path / "cp")).awaitTermination()
    assert led.stats()["records"] == 60 and led.stats()["height"] == 6 and led.verify()
    append_stream(stream(), led, str(tmp_path / "cp2")).awaitTermination()  # all again: nothing new
    assert led.stats()["records"] == 60


def test_empty_inputs(spark, tmp_path):
    led = Ledger(spark, str(tmp_path / "l"))
    assert led.append(puts(spark, [(b"x", b"y", 1)]).filter("false")) == 0 and led.seal() == 0 and led.verify()
    assert led.records().count() == 0 and spark.createDataFrame([], BLOCK).count() == 0
