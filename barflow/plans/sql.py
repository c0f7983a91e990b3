"""Pieces of DuckDB SQL for the comparison statements (independent of the Spark code)."""
from __future__ import annotations

BARS = """b AS (SELECT CAST(l_suppkey AS VARCHAR) AS ticker, l_shipdate AS ts,
  first(px ORDER BY l_orderkey, l_linenumber, l_partkey) AS open, max(px) AS high, min(px) AS low,
  last(px ORDER BY l_orderkey, l_linenumber, l_partkey) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS px FROM lineitem) GROUP BY 1, 2)"""

TICKS = """t AS (SELECT event_type AS ticker, ts, value AS price,
  CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS size, event_id FROM events)"""


def event_bars(minutes: int, name: str = "b") -> str:
    return TICKS + f""", {name} AS (SELECT ticker, time_bucket(INTERVAL '{minutes} minutes', ts, TIMESTAMP '1970-01-01') AS ts,
  first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY ts, event_id) AS close, sum(size) AS volume FROM t GROUP BY 1, 2)"""


BARS_15M = event_bars(15)
BARS_1H = event_bars(60)

WEEKS = BARS + """, wk AS (SELECT ticker, CAST(date_trunc('week', ts) AS TIMESTAMP) AS ts,
  first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close,
  sum(volume) AS volume FROM b GROUP BY 1, 2)"""

POSTS = """p AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'post' ELSE 'comment' END AS type,
  'doc/' || CAST(doc_id AS VARCHAR) AS url, source AS subreddit, lang AS author,
  CAST(n_chars % 1000 AS DOUBLE) AS score, CAST(n_chars % 37 AS DOUBLE) AS num_comments, text,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id * 10) AS created_utc FROM documents)"""

PART = "PARTITION BY ticker ORDER BY ts"


def over(n: int, skip: int = 0) -> str:
    last = f"{skip} PRECEDING" if skip else "CURRENT ROW"
    return f"OVER ({PART} ROWS BETWEEN {n - 1 + skip} PRECEDING AND {last})"


RUN = f"OVER ({PART} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
ROW = f"OVER ({PART})"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) {ROW}"


def lead(x: str, k: int = 1) -> str:
    return f"lead({x}, {k}) {ROW}"


def full(agg: str, x: str, n: int, skip: int = 0) -> str:
    o = over(n, skip)
    return f"CASE WHEN count({x}) {o} = {n} THEN {agg}({x}) {o} END"


def mean(x: str, n: int, skip: int = 0) -> str:
    return full("avg", x, n, skip)


def std(x: str, n: int) -> str:
    return full("stddev_samp", x, n)


def ema(x: str, alpha: float, adjust: bool = False, r: str = "r") -> str:
    """Closed form over a short series; r is the 0-based row number of the ticker."""
    q = 1.0 - alpha
    if adjust:
        return (f"(sum({x} * pow({q!r}, -{r})) {RUN}) * pow({q!r}, {r}) * {alpha!r} / (1 - pow({q!r}, {r} + 1))")
    return f"(sum(CASE WHEN {r} = 0 THEN 1.0 ELSE {alpha!r} END * {x} * pow({q!r}, -{r})) {RUN}) * pow({q!r}, {r})"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def numbered(src: str = "b", name: str = "s") -> str:
    """Rows of src with position r, prior close and bar change."""
    return f"""{name} AS (SELECT *, row_number() {ROW} - 1 AS r, lag(close) {ROW} AS pc,
  close - lag(close) {ROW} AS d, close / nullif(lag(close) {ROW}, 0) - 1 AS ret FROM {src})"""


TR = "greatest(high - low, abs(high - pc), abs(low - pc))"
GAIN = "(CASE WHEN d > 0 THEN d ELSE 0.0 END)"
LOSS = "(CASE WHEN d < 0 THEN -d ELSE 0.0 END)"


def rsi(gain: str, loss: str) -> str:
    """100 where there is gain and no loss, NULL where there is neither."""
    return f"CASE WHEN ({loss}) = 0 THEN CASE WHEN ({gain}) > 0 THEN 100.0 END ELSE 100.0 - 100.0 / (1 + ({gain}) / ({loss})) END"
