"""A ledger that is kept in a store: append-only records, blocks sealed over them, verification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import AppendOnly, DuplicateKey
from .operators import blocks as B
from .operators import ingest, scans, verify
from .schemas import BLOCK, RECORD
from .sources.store import EMPTY, Store


class Ledger:
    """One writer at a time; any number of readers. batch: records in a block."""

    def __init__(self, spark: SparkSession, path: str, batch: int = B.BATCH):
        self.spark, self.batch, self.store = spark, batch, Store(spark, path)

    # ------------------------------------------------------------ reads

    def records(self, generation: int | None = None) -> DataFrame:
        return self.store.read(self.store.manifest(generation)["segments"], RECORD)

    def blocks(self) -> DataFrame:
        now = self.store.manifest()
        return B.genesis(self.spark).unionByName(self.store.read(now["blocks"], BLOCK))

    def get(self, key: bytes) -> bytes | None:
        row = scans.get(self.records(), key).first()
        return None if row is None else bytes(row.value)

    def exists(self, key: bytes) -> bool:
        return scans.get(self.records(), key).first() is not None

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return scans.multi_get(self.records(), keys)

    def scan(self, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        return scans.scan_range(self.records(), start, end)

    def prefix(self, prefix: bytes) -> DataFrame:
        return scans.scan_prefix(self.records(), prefix)

    def page(self, prefix: bytes = b"", limit: int = 100, offset: int = 0) -> DataFrame:
        return scans.page(self.records(), prefix, limit, offset)

    def latest_by_prefix(self, prefix: bytes) -> DataFrame:
        return scans.latest_by_prefix(self.records(), prefix)

    # ------------------------------------------------------------ writes

    def append(self, batch: DataFrame, by: str = "timestamp", ties: Sequence[Column] | None = None, whole: bool = False) -> int:
        """Adds the first row of each new key of (key, value, timestamp, ...), in the order of (by, ties); how many. The others are left out:
        `with_status` tells which. With `whole` all rows are new keys or nothing is written: what is tested is what the commit follows."""
        base = self.store.manifest()
        ties = [F.col("key"), F.col("value")] if ties is None else list(ties)
        new = ingest.accepted(batch, self.store.read(base["segments"], RECORD) if base["segments"] else None, [F.col(by), *ties])
        new = new.persist()
        try:
            segment = self.store.write(ingest.records(new, by, ties, base["sequence"] + 1), "segments")
            left_out = whole and batch.count() != (segment["rows"] if segment else 0)
        finally:
            new.unpersist()
        if left_out:
            self.store.delete([segment] if segment else [])
            raise DuplicateKey("a key of the batch is there, or twice in it")
        if segment is None:
            return 0
        self.store.commit(base, segments=[*base["segments"], segment], sequence=base["sequence"] + segment["rows"], records=base["records"] + segment["rows"])
        return segment["rows"]

    def with_status(self, batch: DataFrame, by: str = "timestamp", ties: Sequence[Column] = ()) -> DataFrame:
        return ingest.with_status(batch, self.records(), [F.col(by), *ties])

    def put(self, key: bytes, value: bytes, timestamp: int) -> None:
        """One record. A job for each: use append for more."""
        if not self.append(self.spark.createDataFrame([(bytearray(key), bytearray(value), timestamp)], "key binary, value binary, timestamp long")):
            raise DuplicateKey(repr(key))

    def delete(self, key: bytes) -> None:
        raise AppendOnly("records can't be deleted: the ledger is append-only")

    def seal(self, force: bool = False) -> int:
        """Seals the full blocks of the records that no block holds yet; with force also the rest. How many blocks."""
        base = self.store.manifest()
        sealed = self.store.read(base["blocks"], BLOCK).agg(F.max(F.col("first_sequence") + F.col("n_records")).alias("s")).first()["s"] or 1
        if force and (sealed - 1) % self.batch:
            raise AppendOnly("a block that isn't full has been sealed; nothing can follow it")
        open_ = self.store.read(base["segments"], RECORD).filter(F.col("sequence_number") >= sealed)
        tip = bytes.fromhex(base["tip"]) if base["tip"] else bytes(B.genesis(self.spark).first().hash)
        segment = self.store.write(B.seal(open_, tip, self.batch, force), "blocks", "index")
        if segment is None:
            return 0
        last = self.store.read([segment], BLOCK).agg(F.max_by("hash", "index").alias("h"), F.max("index").alias("i")).first()
        self.store.commit(base, blocks=[*base["blocks"], segment], height=last.i, tip=bytes(last.h).hex())
        return segment["rows"]

    def compact(self, files: int | None = None) -> None:
        self.store.compact(RECORD, files)

    def reset(self) -> None:
        """Everything goes, as one commit; the segments stay until `vacuum`."""
        base = self.store.manifest()
        self.store.commit(base, **{k: v for k, v in EMPTY.items() if k != "generation"})

    # ------------------------------------------------------------ integrity

    def checks(self, deep: bool = True) -> DataFrame:
        return verify.verify_chain(self.blocks(), self.records(), self.batch, deep)

    def verify(self, deep: bool = True) -> bool:
        """All checks, and the chain ends where the manifest says."""
        now = self.store.manifest()
        if not verify.is_valid(self.checks(deep)).first().valid:
            return False
        return not now["height"] or verify.tip_matches(self.blocks(), now["height"], bytes.fromhex(now["tip"])).first().valid

    def proof(self, hashes: DataFrame) -> DataFrame:
        return verify.proofs(hashes, self.records(), self.batch)

    def stats(self) -> dict:
        now = self.store.manifest()
        return {"records": now["records"], "sequence": now["sequence"], "height": now["height"], "tip": now["tip"], "segments": len(now["segments"]), "pending": now["records"] - now["height"] * self.batch}
