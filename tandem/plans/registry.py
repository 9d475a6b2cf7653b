"""Registered queries and their SQL."""

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None, name: str | None = None):
    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            SQL[key] = sql
        return fn

    return add
