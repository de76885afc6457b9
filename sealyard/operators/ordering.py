"""A gapless sequence in a total order, without a partition that holds everything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import cut

#: Rows of a part that one task sorts; small tables are dealt to more parts, of FEW rows.
ROWS, FEW, SPREAD = 1_000_000, 10_000, 64


def numbered(df: DataFrame, by: str, ties: Sequence[Column] = (), name: str = "sequence_number", start: int = 1, parts: int | None = None) -> DataFrame:
    """Adds `name`: start, start + 1, ... in the order of (by, ties); nulls come first.

    The rows are ranged by (by, ties) into parts of some ROWS, so a frequent value of `by` is split by the ties; each part is sorted and written
    once, and the sizes of the parts before are added. There is a size for each part, so they are broadcast. Rows that tie on everything share a part.
    """
    if parts is None:
        n = df.count()
        parts = max(n // ROWS, min(SPREAD, n // FEW)) + 1
    order = [F.col(by).asc_nulls_first(), *ties]
    # The upper bits of the id are the part's number, the lower ones the place in it.
    placed = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__n", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    place = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("__part", part).join(F.broadcast(sizes), "__part").withColumn(name, (place + F.col("__n") + start).cast("long")).drop("__part", "__id", "__n")
