"""Registered queries and, where SQL can say the same, their DuckDB statement."""
from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def _round_like_spark(sql: str) -> str:
    """round(x, d) -> the tie rule of ``functions.scalar.r`` (halves up, tolerant of noise in the last bits)."""
    at = sql.find("round(")
    if at < 0:
        return sql
    depth, comma, i = 1, -1, at + 6
    while depth:
        ch = sql[i]
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 1:
            comma = i
        i += 1
    x, d = sql[at + 6:comma], int(sql[comma + 1:i - 1])
    return f"{sql[:at]}(floor(CAST({_round_like_spark(x)} AS DOUBLE) * 1e{d} + 0.50001) / 1e{d}){_round_like_spark(sql[i:])}"


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = _round_like_spark(sql)
        return fn
    return add
