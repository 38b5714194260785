"""Errors of the graph layer."""


class GraphError(Exception):
    """Base of all errors of this package."""


class NotFound(GraphError):
    """A point lookup found no element."""


class NotUnique(GraphError):
    """An id, a unique index value or an index itself exists already."""


class NotValid(GraphError):
    """A label, connection, id or property does not fit the schema."""


class NoSchema(GraphError):
    """A schema operation on a graph without schema."""
