"""A small registry: a query and its oracle side by side."""

from __future__ import annotations

from .proxy import oracle


def registry():
    queries, oracles = {}, {}

    def query(sql: str | None = None, name: str | None = None):
        def add(f):
            key = name or f.__name__.rstrip("_")
            queries[key] = f
            if sql:
                oracles[key] = oracle(sql)
            return f

        return add

    return queries, oracles, query
