"""Operations for large-scale training-data pipelines; nothing else in the library imports this."""

from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
