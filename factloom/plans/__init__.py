"""The registered queries, by area."""

from . import analytics, answering, graph, knowledge, resolving, search, tables, vault  # noqa: F401
