"""Secondary indexes as derived tables: field values to keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(docs: DataFrame, fields: Sequence[str], key: str = "key", sparse: bool = False) -> DataFrame:
    """(fields, key), sorted by the fields in each partition for pruning; a sparse index has no rows with a null field."""
    rows = docs.select(*fields, key)
    if sparse:
        rows = rows.dropna(subset=list(fields))
    return rows


def lookup(index: DataFrame, **values) -> DataFrame:
    for name, value in values.items():
        index = index.filter(F.col(name).eqNullSafe(F.lit(value)))
    return index


def unique_violations(index: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Field values that more than one key has, with how many."""
    return index.groupBy(*fields).agg(F.count("*").alias("n")).filter("n > 1")


def taken(new: DataFrame, index: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows of an index whose field values new rows have too; a null field counts as a value."""
    wanted = new.select(*[F.col(f).alias(f"__{f}") for f in fields]).distinct()
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"__{f}"))
    return index.join(wanted, same, "left_semi")


def from_json(docs: DataFrame, fields: Sequence[str], value: str = "value") -> DataFrame:
    """Adds the fields of a JSON value as text columns."""
    return docs.withColumns({f: F.get_json_object(F.col(value).cast("string"), f"$.{f}") for f in fields})
