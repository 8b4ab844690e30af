"""Registered queries with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonrisk.sources.fixtures import FIXTURES, Duck, Tables, needed
from phonrisk.suite.oracle_ctes import CTES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


NUDGE = 1e-10  # moves exact ties off the rounding boundary, so that engines round alike


def r6(value):
    """Six-digit value for comparison; the oracles' ``round(x,6)`` get the same nudge."""
    return F.round((F.col(value) if isinstance(value, str) else value) + F.lit(NUDGE), 6)


def _nudged(sql: str) -> str:
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        depth, i = 1, start + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        body = sql[start + 6:i - 1]
        out.append(sql[at:start])
        if body.rstrip().endswith(",6"):
            out.append(f"round(({_nudged(body.rstrip()[:-2])})+{NUDGE}::double,6)")
        else:
            out.append(f"round({_nudged(body)})")
        at = i
    return "".join(out) + sql[at:]


def _render(sql: str) -> str:
    sql = _nudged(sql)
    duck = Duck()
    pool = {name: make(duck) for name, make in FIXTURES.items()} | CTES
    parts = ",\n".join(f"{n} as ({pool[n]})" for n in needed(sql, pool))
    return f"with {parts}\n{sql}" if parts and not sql.startswith("with ") else f"with {parts},\n{sql[5:]}" if parts else sql


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``oracle`` may name shared CTEs."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle:
            ORACLES[name] = _render(oracle)
        return fn
    return register
