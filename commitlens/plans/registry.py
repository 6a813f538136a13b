"""Registered queries and the SQL that states the same result."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Registers fn(spark, sf_dir) -> DataFrame under name, with its SQL where there is one."""

    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return put
