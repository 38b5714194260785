"""Typed values: type tags, an order over mixed types, ids, and type-sensitive equality."""

from __future__ import annotations

import uuid
from datetime import date, datetime, time, timedelta
from decimal import Decimal
from enum import Enum
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of the value types, as stored data carries them.
TAGS = {
    "null": 1, "boolean": 2, "string": 3, "byte": 4, "short": 5, "int": 6, "long": 7, "float": 8, "double": 9, "decimal": 10, "date": 11,
    "time": 12, "timestamp": 13, "interval": 14, "binary": 15, "enum": 16, "kryo": 17, "serializable": 18, "uuid": 19, "any": 20, "counter": 21,
}
#: Tag name of a Spark type.
SPARK_TAGS = {
    "void": "null", "boolean": "boolean", "string": "string", "tinyint": "byte", "smallint": "short", "int": "int", "bigint": "long",
    "float": "float", "double": "double", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp", "binary": "binary", "variant": "serializable",
}


def tag_of(value: Any) -> str:
    """Tag of a Python value; whole numbers are long, other objects are opaque."""
    kinds = (
        (type(None), "null"), (bool, "boolean"), (Enum, "enum"), (str, "string"), (int, "long"), (float, "double"), (Decimal, "decimal"),
        (datetime, "timestamp"), (date, "date"), (time, "time"), (timedelta, "interval"), ((bytes, bytearray), "binary"), (uuid.UUID, "uuid"),
    )
    return next((tag for kind, tag in kinds if isinstance(value, kind)), "serializable")


def tag_of_type(simple: str) -> str:
    if simple.startswith("decimal"):
        return "decimal"
    if simple.startswith("interval"):
        return "interval"
    return SPARK_TAGS.get(simple, "serializable")


def tag(column: Column, simple: str) -> Column:
    """Tag code of a column of the type: null rows carry the null tag."""
    return F.when(column.isNull(), F.lit(TAGS["null"])).otherwise(F.lit(TAGS[tag_of_type(simple)])).cast("tinyint")


SORT_TYPE = "struct<tag:tinyint,whole:bigint,real:double,exact:decimal(38,9),text:string,raw:binary>"


def sort_key(column: Column, simple: str) -> Column:
    """A value that orders by tag first and by payload then, over columns of any types.
    Numbers keep their own type's slot, so an int never equals a long."""
    kind = tag_of_type(simple)
    slot = {"boolean": "whole", "byte": "whole", "short": "whole", "int": "whole", "long": "whole", "float": "real", "double": "real", "decimal": "exact", "date": "whole", "timestamp": "whole", "interval": "whole", "string": "text", "binary": "raw"}.get(kind, "text")
    payload = {
        "date": F.unix_date(column) if kind == "date" else None,
        "timestamp": F.unix_micros(column.cast("timestamp")) if kind == "timestamp" else None,
        "interval": column.cast("bigint") if kind == "interval" else None,
    }.get(kind)
    payload = column if payload is None else payload
    fields = [tag(column, simple).alias("tag")]
    for name, t in (("whole", "bigint"), ("real", "double"), ("exact", "decimal(38,9)"), ("text", "string"), ("raw", "binary")):
        fields.append((payload.cast(t) if name == slot else F.lit(None).cast(t)).alias(name))
    return F.struct(*fields)


def same(a: Column, a_type: str, b: Column, b_type: str) -> Column:
    """Strict equality: values of different types differ even where numbers agree."""
    return (a == b) if tag_of_type(a_type) == tag_of_type(b_type) else F.lit(False)


def uuid_key(column: Column) -> Column:
    """Order of UUID text as two signed 64-bit numbers."""
    digits = F.regexp_replace(column, "-", "")
    half = lambda at: F.conv(F.substring(digits, at, 16), 16, -10).cast("bigint")
    return F.struct(half(1).alias("high"), half(17).alias("low"))


def normal_id(value: Any, long_numbers: bool = True) -> Any:
    """A missing id becomes random text; numbers become whole (decimals are cut)."""
    if value is None:
        return str(uuid.uuid4())
    if long_numbers and isinstance(value, (int, float, Decimal)) and not isinstance(value, bool):
        return int(value)
    return value


def properties_of(*pairs: Any) -> dict[str, Any]:
    """key, value, key, value ... -> dict without null values."""
    if len(pairs) % 2:
        raise ValueError("a key lacks its value")
    return {k: v for k, v in zip(pairs[::2], pairs[1::2], strict=True) if v is not None}


def cut_seconds(column: Column) -> Column:
    """Timestamps as stored with whole seconds only."""
    return F.date_trunc("second", column)


def bucket(column: Column, n: int = 256) -> Column:
    """A salt that spreads keys over n buckets."""
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
