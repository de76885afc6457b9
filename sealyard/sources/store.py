"""Parquet segments and manifest generations in any file system that Spark can write.

A commit writes a new manifest under the next number, without overwriting: of two writers one fails with Conflict and its
segments stay unnamed. Readers take the manifest of the highest number, so they see whole commits only.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Conflict
from ..operators.compaction import LEVELS, limit, merged

EMPTY = {"generation": 0, "segments": [], "blocks": [], "sequence": 0, "height": 0, "tip": "", "records": 0}


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    # ------------------------------------------------------------ manifests

    def generations(self) -> list[int]:
        folder = self._at("manifest")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def manifest(self, generation: int | None = None) -> dict:
        known = self.generations()
        if not known:
            return dict(EMPTY)
        name = f"manifest/{(known[-1] if generation is None else generation):012d}.json"
        stream = self._fs.open(self._at(name))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def commit(self, base: dict, **changes) -> dict:
        """The manifest after base, with the changes; fails if another writer was faster."""
        after = base | changes | {"generation": base["generation"] + 1}
        target, own = self._at(f"manifest/{after['generation']:012d}.json"), self._at(f"manifest/.{uuid.uuid4().hex}")
        stream = self._fs.create(own, False)
        stream.write(bytearray(json.dumps(after).encode()))
        stream.close()
        # A rename doesn't replace a file on HDFS; on other systems the check before it narrows the gap.
        taken = self._fs.exists(target) or not self._fs.rename(own, target)
        if taken:
            self._fs.delete(own, False)
            raise Conflict(f"generation {after['generation']} is taken")
        return after

    # ------------------------------------------------------------ segments

    def write(self, df: DataFrame, kind: str, sort: str | None = "key") -> dict | None:
        """A segment of df, sorted inside each file so that statistics prune; None if df has no rows."""
        name = f"{kind}/{uuid.uuid4().hex}"
        (df.sortWithinPartitions(sort) if sort else df).write.parquet(f"{self.path}/{name}")
        rows = self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}").count()
        return {"name": name, "rows": rows, "level": 0} if rows else None

    def read(self, segments: list[dict], schema: str) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{s['name']}" for s in segments])

    def delete(self, segments: list[dict]) -> None:
        for s in segments:
            self._fs.delete(self._at(s["name"]), True)

    def remove(self) -> None:
        """Everything goes, manifests too."""
        self._fs.delete(self._at(""), True)

    def compact(self, schema: str, files: int | None = None) -> dict:
        """Merges each level that holds too many runs into one run of the next, ranged by key; later runs win. The old segments stay for readers of
        older generations until `vacuum`."""
        base = self.manifest()
        segments = list(base["segments"])
        for level in range(LEVELS - 1):
            own = [s for s in segments if s["level"] == level]
            if len(own) <= limit(level):
                continue
            runs = None
            for order, s in enumerate(own):
                part = self.read([s], schema).withColumn("run_order", F.lit(order))
                runs = part if runs is None else runs.unionByName(part)
            rows = merged(runs).select(*self.spark.createDataFrame([], schema).columns)
            ranged = rows.repartitionByRange(files, "key") if files else rows.repartitionByRange("key")
            new = self.write(ranged, "segments")
            first = segments.index(own[0])
            segments = [s for s in segments if s["level"] != level]
            segments.insert(min(first, len(segments)), new | {"level": level + 1})
        return base if segments == base["segments"] else self.commit(base, segments=segments)

    def vacuum(self) -> list[str]:
        """Deletes segments that the newest manifest doesn't name. No reader of an older one may be running."""
        now = self.manifest()
        named = {s["name"] for s in now["segments"] + now["blocks"]}
        gone = []
        for kind in ("segments", "blocks"):
            folder = self._at(kind)
            if self._fs.exists(folder):
                for s in self._fs.listStatus(folder):
                    name = f"{kind}/{s.getPath().getName()}"
                    if name not in named:
                        self._fs.delete(s.getPath(), True)
                        gone.append(name)
        return gone
