"""Declared schemas of collections, compiled to Columns that list a document's violations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Invalid

#: Declared type to the VARIANT types that fit it.
TYPES = {
    "String": ("STRING",),
    "Integer": ("BIGINT",),
    "Float": ("BIGINT", "DOUBLE", "DECIMAL"),
    "Boolean": ("BOOLEAN",),
    "Array": ("ARRAY",),
    "Object": ("OBJECT",),
    "Binary": ("STRING",),
    "Timestamp": ("STRING", "BIGINT", "TIMESTAMP"),
}


@dataclass(frozen=True)
class Field:
    """rules: MinLength, MaxLength, Pattern, MinValue, MaxValue, OneOf, each with its value."""

    type: str
    required: bool = False
    default: object = None
    rules: Mapping[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class Index:
    name: str
    fields: Sequence[str]
    unique: bool = False
    sparse: bool = False


@dataclass(frozen=True)
class Schema:
    fields: Mapping[str, Field] = field(default_factory=dict)
    required: Sequence[str] = ()
    indexes: Sequence[Index] = ()
    version: int = 1

    def with_index(self, index: Index) -> Schema:
        if not index.fields:
            raise Invalid("an index needs a field")
        return Schema(self.fields, self.required, [*self.indexes, index], self.version)

    def without_index(self, name: str) -> Schema:
        return Schema(self.fields, self.required, [i for i in self.indexes if i.name != name], self.version)


def _broken(rule: str, bound, text: Column, number: Column) -> Column:
    if rule == "MinLength":
        return F.length(text) < bound
    if rule == "MaxLength":
        return F.length(text) > bound
    if rule == "Pattern":
        return ~text.rlike(bound)
    if rule == "MinValue":
        return number < bound
    if rule == "MaxValue":
        return number > bound
    if rule == "OneOf":
        return ~text.isin(list(bound))
    raise Invalid(f"unknown rule {rule}")


def violations(document: Column, schema: Schema) -> Column:
    """An array of 'field: what' for a JSON text; 'document: not JSON' if it isn't an object."""
    # A lambda's argument is a value: the text is parsed once for each document, and each field read once.
    return _value(F.try_parse_json(document), lambda parsed: _of_parsed(parsed, schema))


def _value(x: Column, use) -> Column:
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _of_parsed(parsed: Column, schema: Schema) -> Column:
    bad = parsed.isNull() | ~F.schema_of_variant(parsed).startswith("OBJECT")
    fields = [F.lit(None).cast("array<string>")]
    for name, spec in schema.fields.items():
        own = F.struct(F.try_variant_get(parsed, f"$.{name}", "variant").alias("v"), F.try_variant_get(parsed, f"$.{name}", "string").alias("text"), F.try_variant_get(parsed, f"$.{name}", "double").alias("number"))
        fields.append(_value(own, _checker(name, spec, spec.required or name in schema.required)))
    good = F.flatten(F.array_compact(F.array(*fields)))
    return F.when(bad, F.array(F.lit("document: not JSON"))).otherwise(good)


def _checker(name: str, spec: Field, required: bool):
    return lambda f: _of_field(f, name, spec, required)


def _of_field(f: Column, name: str, spec: Field, required: bool) -> Column:
    kind = F.regexp_extract(F.schema_of_variant(f["v"]), "^[A-Z]+", 0)
    missing = f["v"].isNull() | F.is_variant_null(f["v"])
    found = [F.when(~kind.isin(*TYPES[spec.type]), F.lit(f"{name}: not {spec.type}"))]
    found += [F.when(_broken(rule, bound, f["text"], f["number"]), F.lit(f"{name}: {rule}")) for rule, bound in spec.rules.items()]
    none = F.array(F.lit(f"{name}: missing")) if required else F.array().cast("array<string>")
    return F.when(missing, none).otherwise(F.array_compact(F.array(*found)))


#: A document's size, unless the collection's settings say otherwise.
MAX_BYTES = 16 << 20


def validated(docs: DataFrame, schema: Schema, value: str = "value", max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """Adds `violations` to each row; too large a document is one, unless max_bytes is None."""
    own = violations(F.col(value).cast("string"), schema)
    large = F.when(F.octet_length(F.col(value)) > F.lit(max_bytes).cast("long"), F.array(F.lit("document: too large"))).otherwise(F.array().cast("array<string>"))
    return docs.withColumn("violations", F.concat(large, own))
