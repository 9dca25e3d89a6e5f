"""Queries by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The ticks that marea.sources.ticks reads, in SQL; queries append to it.
TICKS = """WITH t AS (SELECT user_id AS entity_id, ts AS event_time, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
  value AS price, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS volume, event_type AS label FROM events)"""
BARS = TICKS + """, b AS (SELECT entity_id, CAST(event_time AS DATE) AS day, arg_min(price, event_id) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, event_id) AS close, sum(volume) AS volume, count(*) AS n_ticks FROM t GROUP BY 1, 2)"""


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add
