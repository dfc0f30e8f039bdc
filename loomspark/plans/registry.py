"""The registered queries of the relational part, with their DuckDB SQL; the modules of this folder fill it."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a (spark, sf_dir) function under its own name, with its oracle SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add
