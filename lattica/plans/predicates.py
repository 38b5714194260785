"""Predicates on values.  A missing value fails every predicate, the negated ones too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class P:
    def __init__(self, test: Callable[[Column], Column]):
        self.test = test

    def __call__(self, c: Column) -> Column:
        return c.isNotNull() & self.test(c)

    def and_(self, other: P) -> P:
        return P(lambda c: self.test(c) & other.test(c))

    def or_(self, other: P) -> P:
        return P(lambda c: self.test(c) | other.test(c))

    def negate(self) -> P:
        return P(lambda c: ~self.test(c))


def eq(v) -> P:
    return P(lambda c: F.lit(False) if v is None else c == v)


def neq(v) -> P:
    return P(lambda c: F.lit(True) if v is None else c != v)


def lt(v) -> P:
    return P(lambda c: c < v)


def lte(v) -> P:
    return P(lambda c: c <= v)


def gt(v) -> P:
    return P(lambda c: c > v)


def gte(v) -> P:
    return P(lambda c: c >= v)


def between(a, b) -> P:
    """[a, b)"""
    return P(lambda c: (c >= a) & (c < b))


def inside(a, b) -> P:
    """(a, b)"""
    return P(lambda c: (c > a) & (c < b))


def outside(a, b) -> P:
    return P(lambda c: (c < a) | (c > b))


def within(*values) -> P:
    return P(lambda c: c.isin(*values) if values else F.lit(False))


def without(*values) -> P:
    return within(*values).negate()


def starting_with(s: str) -> P:
    return P(lambda c: c.startswith(s))


def ending_with(s: str) -> P:
    return P(lambda c: c.endswith(s))


def containing(s: str) -> P:
    return P(lambda c: c.contains(s))


def regex(pattern: str) -> P:
    """Found anywhere in the value."""
    return P(lambda c: c.rlike(pattern))


def not_starting_with(s: str) -> P:
    return starting_with(s).negate()


def not_ending_with(s: str) -> P:
    return ending_with(s).negate()


def not_containing(s: str) -> P:
    return containing(s).negate()


def not_regex(pattern: str) -> P:
    return regex(pattern).negate()
