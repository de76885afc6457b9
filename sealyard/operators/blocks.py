"""Blocks: every `batch` records are sealed with their Merkle root and chained by hash."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.hashing import ZERO32, block_hash, concat_all, merkle_root, record_hash
from ..schemas import BLOCK
from .chains import linked

BATCH = 1000
#: Records whose blocks one task links: 32 MB of hashes.
PART = 1_000_000


def block_index(batch: int):
    """Block of a sequence number: 1 for the first `batch` records."""
    return F.floor((F.col("sequence_number") - 1) / batch) + 1


def grouped(records: DataFrame, batch: int = BATCH, check: bool = False) -> DataFrame:
    """(index, timestamp in s, hashes in order, merkle_root, first_sequence, n_records) of each block, full or not. A group has at most `batch` rows.

    With check also `wrong`: how many records don't have the hash that their fields give.
    """
    checked = F.count_if(F.col("hash") != record_hash("key", "value", "timestamp", "sequence_number")) if check else F.lit(0)
    ordered = F.array_sort(F.collect_list(F.struct("sequence_number", "hash")))
    found = records.withColumn("index", block_index(batch).cast("long")).groupBy("index").agg(ordered.alias("r"), F.floor(F.max("timestamp") / 1000).cast("long").alias("timestamp"), checked.alias("wrong"))
    found = found.withColumn("hashes", F.transform("r", lambda x: x["hash"]))
    return found.select("index", "timestamp", "hashes", merkle_root("hashes").alias("merkle_root"), F.get("r", F.lit(0))["sequence_number"].alias("first_sequence"), F.size("r").cast("long").alias("n_records"), "wrong").drop(*([] if check else ["wrong"]))


def genesis(spark, timestamp: int = 0) -> DataFrame:
    """Block 0: no records, zero root, zero link."""
    digest = hashlib.sha256((0).to_bytes(8, "big") + timestamp.to_bytes(8, "big") + ZERO32 + ZERO32 + bytes(8)).digest()
    return spark.createDataFrame([(0, timestamp, ZERO32, ZERO32, digest, 0, 0, 0)], BLOCK)


def chained(groups: DataFrame, previous: bytes, part: int = PART // BATCH) -> DataFrame:
    """Headers of new blocks after the block whose hash is `previous`.

    A hash needs the one before it, so blocks are hashed one after another by their nature; roots and record hashes are ready by then. `part` blocks
    at a time are linked by one task, which reads a header and 32 bytes a record. It runs over the blocks of an append, not over the chain.
    """
    names = [field.split()[0] for field in BLOCK.split(", ")]

    def link(batches, last):
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            links, hashes = [], []
            for i, ts, root, joined in zip(cols["index"], cols["timestamp"], cols["merkle_root"], cols["joined"], strict=True):
                links.append(last)
                last = hashlib.sha256(i.to_bytes(8, "big") + ts.to_bytes(8, "big") + last + root + bytes(8) + joined).digest()
                hashes.append(last)
            own = {"previous_hash": pa.array(links, pa.binary()), "hash": pa.array(hashes, pa.binary()), "nonce": pa.array([0] * len(links), pa.int64())}
            yield pa.RecordBatch.from_arrays([own.get(c, batch.column(c) if c in cols else None) for c in names], names=names)

    lean = groups.select("index", "timestamp", "merkle_root", "first_sequence", "n_records", concat_all("hashes").alias("joined"))
    return linked(lean, F.floor(F.col("index") / part), "index", link, StructType.fromDDL(BLOCK), "hash", previous)


def seal(records: DataFrame, previous: bytes, batch: int = BATCH, force: bool = False) -> DataFrame:
    """Headers of the full blocks of records; with force also of a last one that isn't full."""
    groups = grouped(records, batch)
    return chained(groups if force else groups.filter(F.col("n_records") == batch), previous, max(1, PART // batch))


def recomputed(blocks: DataFrame, records: DataFrame, batch: int = BATCH, check: bool = False) -> DataFrame:
    """Each stored header with the root and hash that its records give (true_root, true_hash, true_n, wrong), in one pass over the records and in
    parallel, as the stored link is used. With check also a row with null `hash` for each full block of records that no header stands for."""
    groups = grouped(records, batch, check).select("index", "hashes", F.col("merkle_root").alias("true_root"), F.col("n_records").alias("true_n"), F.col("wrong") if check else F.lit(0).alias("wrong"))
    found = blocks.join(groups, "index", "full_outer" if check else "left").filter(F.col("hash").isNotNull() | (F.col("true_n") == batch))
    joined = F.coalesce(concat_all("hashes"), F.lit(b""))
    return found.withColumn("true_hash", block_hash("index", "timestamp", "previous_hash", "merkle_root", "nonce", joined)).drop("hashes")
