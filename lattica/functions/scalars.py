"""Scalar steps on strings, dates and lists, as column expressions.

String and list positions count from 0; a negative position counts from the end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"second": "SECOND", "minute": "MINUTE", "hour": "HOUR", "day": "DAY"}


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# strings


def concat(c: Column, *others) -> Column:
    """Nulls among the others are left out; null if nothing is left."""
    parts = [c, *map(_col, others)]
    joined = F.concat(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.when(F.coalesce(*(p.cast("string") for p in parts)).isNotNull(), joined)


def as_string(c: Column) -> Column:
    return c.cast("string")


def length(c: Column) -> Column:
    return F.length(c)


def to_lower(c: Column) -> Column:
    return F.lower(c)


def to_upper(c: Column) -> Column:
    return F.upper(c)


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def l_trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+", "")


def r_trim(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+$", "")


def reverse(c: Column) -> Column:
    return F.reverse(c)


def replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def split(c: Column, separator: str) -> Column:
    """A literal separator; an empty one gives characters."""
    return F.split(c, r"(?<=.)(?=.)" if separator == "" else r"\Q" + separator + r"\E")


def substring(c: Column, start: int, end: int | None = None) -> Column:
    """[start, end) as in slices."""
    n = F.length(c)
    at = lambda x: F.greatest(n + x, F.lit(0)) if x < 0 else F.least(F.lit(x), n)
    first, last = at(start), n if end is None else at(end)
    return F.substr(c, first + 1, F.greatest(last - first, F.lit(0)))


def format_string(template: str, values: dict[str, Column]) -> Column:
    """%{key} stands for a value; null if one is missing."""
    parts, rest = [], template
    while "%{" in rest:
        head, _, tail = rest.partition("%{")
        key, _, rest = tail.partition("}")
        parts += [F.lit(head), values[key].cast("string")]
    return F.concat(*parts, F.lit(rest))


# dates


def as_date(c: Column) -> Column:
    return F.to_timestamp(c)


def date_add(c: Column, unit: str, n: int) -> Column:
    return F.timestamp_add(UNITS[unit], F.lit(n), c)


def date_diff(c: Column, other) -> Column:
    """Seconds from the other one to this one."""
    return F.unix_timestamp(c) - F.unix_timestamp(_col(other))


# lists


def all_(c: Column, test) -> Column:
    return F.forall(c, test)


def any_(c: Column, test) -> Column:
    return F.exists(c, test)


def none_(c: Column, test) -> Column:
    return ~F.exists(c, test)


def combine(c: Column, other) -> Column:
    """Both lists, repeats kept."""
    return F.concat(c, _col(other))


def conjoin(c: Column, separator: str) -> Column:
    return F.array_join(c, separator)


def difference(c: Column, other) -> Column:
    return F.array_except(c, _col(other))


def disjunct(c: Column, other) -> Column:
    other = _col(other)
    return F.array_union(F.array_except(c, other), F.array_except(other, c))


def intersect(c: Column, other) -> Column:
    return F.array_intersect(c, _col(other))


def merge(c: Column, other) -> Column:
    """Both lists, each element once."""
    return F.array_union(c, _col(other))


def product(c: Column, other) -> Column:
    """All pairs of elements within one row."""
    other = _col(other)
    return F.flatten(F.transform(c, lambda a: F.transform(other, lambda b: F.array(a, b))))
