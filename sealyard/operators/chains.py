"""Chains: a link hashes the one before it, so parts of bounded size are linked one after another."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .checkpoints import shared

#: Files of a part, so that one task needn't write it.
FILES = 8


def linked(rows: DataFrame, part: Column, by: str, link: Callable, schema: StructType, tip: str, previous: bytes | None) -> DataFrame:
    """What `link(batches, last)` makes of all rows in the order of the integer `by`, `last` being the `tip` of the row before, at first `previous`.

    `part` numbers parts of bounded size in that order. The rows are written once, by part; then a task reads one part, sorts it and links
    it. The driver carries the tip from part to part, so no task reads or sorts more than a part, however long the chain.
    """
    spark = rows.sparkSession
    folder = f"{shared(spark)}/chain-{uuid.uuid4().hex}"
    dealt = rows.withColumn("part", part.cast("long"))
    dealt.repartition("part", F.pmod(F.col(by), F.lit(FILES))).write.partitionBy("part").parquet(f"{folder}/rows")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(path)]
    parts = sorted(int(n.removeprefix("part=")) for n in names if n.startswith("part="))
    for k in parts:
        own = spark.read.schema(rows.schema).parquet(f"{folder}/rows/part={k}").coalesce(1).sortWithinPartitions(by)
        own.mapInArrow(lambda batches, last=previous: link(batches, last), schema).write.parquet(f"{folder}/links/{k}")
        done = spark.read.schema(schema).parquet(f"{folder}/links/{k}")
        previous = bytes(done.agg(F.max_by(tip, by)).first()[0])
    files.delete(path, True)
    return spark.read.schema(schema).parquet(*[f"{folder}/links/{k}" for k in parts]) if parts else spark.createDataFrame([], schema)
