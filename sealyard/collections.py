"""Collections: named ledgers that don't see each other's keys, with schemas and indexes."""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import Invalid, NotFound
from .ledger import Ledger
from .operators import indexes, ingest, scans, validation
from .operators.validation import MAX_BYTES, Field, Index, Schema
from .sources.store import Store


class Collections:
    """The catalog is the manifest of a store of its own; statistics are derived, never kept."""

    def __init__(self, spark: SparkSession, path: str, batch: int = 1000):
        self.spark, self.path, self.batch, self.store = spark, path.rstrip("/"), batch, Store(spark, f"{path.rstrip('/')}/catalog")

    def _all(self) -> list[dict]:
        return self.store.manifest().get("collections", [])

    def names(self) -> list[str]:
        return [c["name"] for c in self._all()]

    def create(self, name: str, description: str = "", created_by: str = "", schema: Schema | None = None, settings: dict | None = None) -> Collection:
        base = self.store.manifest()
        known = base.get("collections", [])
        if any(c["name"] == name for c in known):
            raise Invalid(f"there is a collection {name!r}")
        own = {"id": f"col_{uuid.uuid4()}", "name": name, "description": description, "created_by": created_by, "schema": dataclasses.asdict(schema) if schema else None, "settings": settings or {}}
        self.store.commit(base, collections=[*known, own])
        return Collection(self, own)

    def get(self, name: str) -> Collection:
        for c in self._all():
            if name in (c["name"], c["id"]):
                return Collection(self, c)
        raise NotFound(f"no collection {name!r}")

    def drop(self, name: str) -> None:
        own = self.get(name).meta
        base = self.store.manifest()
        self.store.commit(base, collections=[c for c in base["collections"] if c["id"] != own["id"]])
        Store(self.spark, f"{self.path}/collections/{own['id']}").remove()

    def update(self, own: dict) -> None:
        base = self.store.manifest()
        self.store.commit(base, collections=[own if c["id"] == own["id"] else c for c in base["collections"]])

    def catalog(self) -> DataFrame:
        rows = [(c["id"], c["name"], c["description"], c["created_by"]) for c in self._all()]
        return self.spark.createDataFrame(rows, "collection_id string, name string, description string, created_by string")

    def records(self) -> DataFrame | None:
        """Records of all collections, each with its collection_id."""
        parts = [Collection(self, c).ledger.records().withColumn("collection_id", F.lit(c["id"])) for c in self._all()]
        out = parts[0] if parts else None
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def verify(self) -> dict[str, bool]:
        return {c["name"]: Collection(self, c).ledger.verify() for c in self._all()}

    def reset(self) -> None:
        for c in self._all():
            Collection(self, c).ledger.reset()


class Collection:
    def __init__(self, owner: Collections, meta: dict):
        self.owner, self.meta = owner, meta
        self.ledger = Ledger(owner.spark, f"{owner.path}/collections/{meta['id']}", owner.batch)

    @property
    def schema(self) -> Schema | None:
        s = self.meta["schema"]
        if s is None:
            return None
        return Schema({k: Field(**v) for k, v in s["fields"].items()}, s["required"], [Index(**i) for i in s["indexes"]], s["version"])

    def _save(self, schema: Schema) -> None:
        self.meta = self.meta | {"schema": dataclasses.asdict(schema)}
        self.owner.update(self.meta)

    def append(self, batch: DataFrame, by: str = "timestamp") -> int:
        """Valid new documents are added. Any violation of the schema, of the settings' size, or of a unique index refuses the batch."""
        schema, size = self.schema, self.meta["settings"].get("max_document_size", MAX_BYTES)
        large = batch.filter(F.octet_length("value") > size) if size is not None else None
        if large is not None and large.limit(1).count():
            raise Invalid("document: too large")
        if schema is not None:
            bad = validation.validated(batch, schema, max_bytes=size).filter(F.size("violations") > 0).select("violations").first()
            if bad is not None:
                raise Invalid(", ".join(bad.violations))
            for index in schema.indexes:
                if index.unique:
                    # Only what the append will add counts; the ledger's values are read once and meet the batch's fields, which are broadcast if few.
                    known = self.ledger.records()
                    new = ingest.accepted(batch.select("key", "value", by), known, [F.col(by), F.col("key"), F.col("value")])
                    own, old = (indexes.build(indexes.from_json(x, index.fields), index.fields, sparse=index.sparse) for x in (new, known))
                    if indexes.unique_violations(own, index.fields).first() is not None or indexes.taken(own, old, index.fields).first() is not None:
                        raise Invalid(f"index {index.name} is unique")
        return self.ledger.append(batch, by)

    def documents(self, now: int) -> DataFrame:
        """Records that the settings' time to live still shows."""
        return scans.living(self.ledger.records(), now, self.meta["settings"].get("ttl_seconds"))

    def create_index(self, index: Index) -> None:
        self._save((self.schema or Schema()).with_index(index))

    def drop_index(self, name: str) -> None:
        if self.schema is not None:
            self._save(self.schema.without_index(name))

    def index(self, name: str) -> DataFrame:
        for i in self.schema.indexes if self.schema else ():
            if i.name == name:
                return indexes.build(indexes.from_json(self.ledger.records(), i.fields), i.fields, sparse=i.sparse)
        raise NotFound(f"no index {name!r}")
