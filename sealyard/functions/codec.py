"""Byte encodings as Columns, and the bound that turns a prefix into a range."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def be8(x: Column | str) -> Column:
    """A non-negative BIGINT as 8 bytes, most significant first."""
    return F.unhex(F.lpad(F.hex(_col(x)), 16, "0"))


def le8(x: Column | str) -> Column:
    """A non-negative BIGINT as 8 bytes, least significant first. reverse() of BINARY would reverse characters, so hex pairs are."""
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(_col(x)), 16, "0"), F.lit("(..)"))), ""))


def sha256(x: Column | str) -> Column:
    return F.unhex(F.sha2(_col(x).cast("binary"), 256))


def hex_lower(x: Column | str) -> Column:
    return F.lower(F.hex(_col(x)))


def to_base64(x: Column | str) -> Column:
    """Base64 on one line; Spark breaks lines after 76 characters."""
    return F.regexp_replace(F.base64(_col(x)), r"[\r\n]", "")


def from_base64(x: Column | str) -> Column:
    """Null where the text isn't base64."""
    return F.try_to_binary(_col(x), F.lit("base64"))


def lossy_utf8(x: Column | str) -> Column:
    """Text with U+FFFD for what isn't UTF-8."""
    return F.make_valid_utf8(_col(x).cast("string"))


def decode_field(x: Column | str, encoding: Column | str) -> Column:
    """Request field to bytes: base64 if the encoding says so, else the text's UTF-8."""
    return F.when(_col(encoding) == "base64", from_base64(x)).otherwise(_col(x).cast("binary"))


def encode_field(x: Column | str, encoding: Column | str) -> Column:
    return F.when(_col(encoding) == "base64", to_base64(x)).otherwise(lossy_utf8(x))


def field_list(x: Column | str) -> Column:
    """'a, b' to ['a', 'b']."""
    return F.transform(F.split(_col(x), ","), lambda p: F.trim(p))


def node_url(host: Column | str, port: Column | str) -> Column:
    return F.format_string("http://%s:%d", _col(host), _col(port))


def successor(prefix: bytes) -> bytes | None:
    """The least key above all keys with the prefix; None if there is no bound."""
    head = prefix.rstrip(b"\xff")
    return head[:-1] + bytes([head[-1] + 1]) if head else None


def has_prefix(key: Column | str, prefix: bytes) -> Column:
    """startswith on BINARY isn't pushed to Parquet; a range is."""
    above = successor(prefix)
    found = _col(key) >= F.lit(prefix)
    return found if above is None else found & (_col(key) < F.lit(above))


def record_size(key: Column | str, value: Column | str, hash_: Column | str) -> Column:
    """Bytes that a record counts for in memory: its fields and a fixed 48."""
    return F.octet_length(_col(key)) + F.octet_length(_col(value)) + F.octet_length(_col(hash_)) + F.lit(48)


def majority(n: Column | str) -> Column:
    return F.floor(_col(n) / 2) + 1


def password_ok(x: Column | str, least: int = 8, strong: bool = True) -> Column:
    """At least so many bytes; if strong, with an upper-case and a lower-case letter, a digit, and a sign that is none of them."""
    ok = F.octet_length(_col(x)) >= least
    if strong:
        for pattern in (r"\p{Lu}", r"\p{Ll}", "[0-9]", r"[^\p{L}\p{N}]"):
            ok = ok & _col(x).rlike(pattern)
    return ok
