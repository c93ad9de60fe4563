"""Collects the queries of a module with their SQL."""

from __future__ import annotations


def registry():
    queries, oracles = {}, {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return query, queries, oracles
