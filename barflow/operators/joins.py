"""Time joins built from equi-joins on (ticker, clock bucket).

Bars are unique per (ticker, ts), so a bucket of ``bucket_rows`` intervals holds a bounded, sorted array of bars.  The
other side meets that one row per bucket: no range join, no pairs, and a hot bucket on the left is split by adaptive
execution because the right side has one row per key."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from barflow.operators import series as S
from barflow.session import cut_lineage

c = F.col
BUCKET_ROWS = 32


def _bucket(ts: Column, span_s: int) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / F.lit(span_s))


def _bucket_arrays(bars: DataFrame, cols: list[str], span_s: int, early_s: int = 0) -> DataFrame:
    """Sorted bars of each bucket; with ``early_s`` also of the buckets that begin up to so many seconds before a bar."""
    own = _bucket(c("ts"), span_s)
    if early_s:
        own = F.explode(F.sequence(_bucket(c("ts") - F.make_dt_interval(secs=F.lit(early_s)), span_s), own))
    return bars.select("ticker", own.alias("_tb"), F.struct("ts", *cols).alias("_bar")).filter(c("ticker").isNotNull() & c("_tb").isNotNull()) \
        .groupBy("ticker", "_tb").agg(F.array_sort(F.collect_list("_bar")).alias("_bars"))


#: Buckets of a block in ``known_around``.
BLOCK_BUCKETS = 4096


def known_around(rows: DataFrame, order: str, before: dict[str, str] | None = None, after: dict[str, str] | None = None,
                 block: int = BLOCK_BUCKETS) -> DataFrame:
    """Last known and next known values along a ticker: for ``name -> column`` in ``before``, the last non-NULL value of the column on an earlier
    row; in ``after``, the first one on a later row. ``order`` is a whole number, unique within a ticker.

    A block-carried scan: windows run over blocks of ``block`` steps of ``order``, so they are bounded; each block gives one row with its own
    first and last known values, these rows alone are scanned along the ticker, and what they carry fills the edges of the blocks."""
    before, after = before or {}, after or {}
    rows = rows.withColumn("_sb", F.floor(c(order) / F.lit(block)))
    rows = rows.filter(c("ticker").isNotNull() & c("_sb").isNotNull())      # the join below drops them anyway; said here, both of its sides share their shuffles
    known = lambda x: F.when(c(x).isNotNull(), c(order))
    edge = rows.groupBy("ticker", "_sb").agg(*[F.max_by(x, known(x)).alias(f"_e{n}") for n, x in before.items()],
                                             *[F.min_by(x, known(x)).alias(f"_e{n}") for n, x in after.items()])
    along = Window.partitionBy("ticker").orderBy("_sb")
    up, down = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
    carry = edge.select("ticker", "_sb", *[F.last(f"_e{n}", ignorenulls=True).over(up).alias(f"_e{n}") for n in before],
                        *[F.first(f"_e{n}", ignorenulls=True).over(down).alias(f"_e{n}") for n in after])
    inside = Window.partitionBy("ticker", "_sb").orderBy(order)
    back = Window.partitionBy("ticker", "_sb").orderBy(c(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({**{n: F.last(x, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)) for n, x in before.items()},
                             **{n: F.last(x, ignorenulls=True).over(back) for n, x in after.items()}})
    rows = rows.join(carry, ["ticker", "_sb"])
    return rows.withColumns({n: F.coalesce(c(n), c(f"_e{n}")) for n in [*before, *after]}).drop("_sb", *[f"_e{n}" for n in [*before, *after]])


def asof_join(left: DataFrame, bars: DataFrame, at: str, cols: list[str], direction: str = "forward",
              interval_s: int = 900, bucket_rows: int = BUCKET_ROWS, out: str = "hit", block: int = BLOCK_BUCKETS) -> DataFrame:
    """Add ``out`` = struct(ts, *cols) of the bar at or after ('forward'), at or before ('backward') or closest to
    ('nearest', the earlier one on a tie) the time in column ``at``; NULL where there is none.

    A bucket is reduced to its first and last bar, ``known_around`` carries those over buckets without bars, and the bars of a
    bucket meet the rows that ask for it afterwards: no window holds them, and none but the one over blocks runs along a whole ticker."""
    span = interval_s * bucket_rows
    probe = left.withColumn("_tb", _bucket(c(at), span))
    arrays = _bucket_arrays(bars, cols, span)      # read twice, with the same columns, so that its shuffle is shared and ``bars`` are made once
    edges = arrays.select("ticker", "_tb", F.element_at("_bars", F.lit(1)).alias("_first"), F.element_at("_bars", F.lit(-1)).alias("_last"))
    none = F.lit(None).cast(edges.schema["_first"].dataType)
    asked = probe.select("ticker", "_tb", none.alias("_first"), none.alias("_last"))
    keys = edges.unionByName(asked).groupBy("ticker", "_tb").agg(F.max("_first").alias("_first"), F.max("_last").alias("_last"))
    grid = known_around(keys, "_tb", {"_prev": "_last"} if direction != "forward" else {}, {"_next": "_first"} if direction != "backward" else {}, block)
    grid = grid.drop("_first", "_last").join(arrays, ["ticker", "_tb"], "left")
    df = probe.join(grid, ["ticker", "_tb"], "left")
    before = after = None
    if direction != "forward":
        before = F.coalesce(F.try_element_at(F.filter("_bars", lambda b: b["ts"] <= c(at)), F.lit(-1)), c("_prev"))
    if direction != "backward":
        after = F.coalesce(F.try_element_at(F.filter("_bars", lambda b: b["ts"] >= c(at)), F.lit(1)), c("_next"))
    if direction == "nearest":
        df = df.withColumns({"_a": before, "_z": after})
        t = F.unix_micros(c(at).cast("timestamp"))
        gap_a = t - F.unix_micros(c("_a.ts").cast("timestamp"))
        gap_z = F.unix_micros(c("_z.ts").cast("timestamp")) - t
        pick = F.when(c("_z").isNull() | (gap_a <= gap_z), c("_a")).otherwise(c("_z"))
    else:
        pick = after if direction == "forward" else before
    return df.withColumn(out, pick).drop("_tb", "_bars", "_prev", "_next", "_a", "_z")


def bars_after(left: DataFrame, key: list[str], bars: DataFrame, cols: list[str], horizon_s: int, interval_s: int = 86400,
               bucket_rows: int = BUCKET_ROWS, out: str = "future") -> DataFrame:
    """Range join: all bars strictly after ``ts`` and at most ``horizon_s`` later, as one sorted array per left row.

    ``key`` identifies a left row.  A bar goes to its own bucket and to the one before, if rows there reach it; a bucket is as long as the horizon at least, so
    there is one other at most. A left row meets the array of its bucket and keeps what it reaches: no row is repeated, and no array is shuffled again.
    The array is bounded by horizon / interval, that of a bucket by (horizon + bucket) / interval."""
    span = max(interval_s * bucket_rows, horizon_s)
    end = c("ts") + F.make_dt_interval(secs=F.lit(horizon_s))
    hit = left.withColumn("_tb", _bucket(c("ts"), span)).join(_bucket_arrays(bars, cols, span, horizon_s), ["ticker", "_tb"], "left")
    return hit.withColumn(out, F.filter("_bars", lambda b: (b["ts"] > c("ts")) & (b["ts"] <= end))).drop("_tb", "_bars")


#: Children of a node, and seconds that make every time of the calendar positive.
FANOUT, EPOCH_S = 256, 1 << 36


def touch_tree(bars: DataFrame, interval_s: int) -> list[DataFrame]:
    """Levels (ticker, _p, _kids) of a tree over the clock, lowest first. The children of a node of the lowest level are its bars, those of a higher one the
    nodes of the level below, each with its highest high and lowest low; FANOUT of them at most. A level has 1/FANOUT of the rows of the one
    below; all are cut from their lineage, since a search reads each several times. The level that has one node per ticker is the last."""
    kid = F.struct(F.unix_micros(c("ts").cast("timestamp")).alias("id"), c("high").alias("hi"), c("low").alias("lo"), "ts")
    row = bars.select("ticker", _clock("ts", interval_s * FANOUT).alias("_p"), kid.alias("_kid"))
    ts_type, levels, depth = bars.schema["ts"].dataType, [], 1
    while True:
        levels.append(cut_lineage(row.groupBy("ticker", "_p").agg(F.array_sort(F.collect_list("_kid")).alias("_kids"))))
        if interval_s * FANOUT ** depth > 1 << 40 or levels[-1].groupBy("ticker").count().filter(c("count") > 1).isEmpty():
            return levels
        kid = F.struct(c("_p").alias("id"), F.array_max("_kids.hi").alias("hi"), F.array_min("_kids.lo").alias("lo"), F.lit(None).cast(ts_type).alias("ts"))
        row = levels[-1].select("ticker", F.floor(c("_p") / FANOUT).alias("_p"), kid.alias("_kid"))
        depth += 1


def _clock(at: str, span_s: int) -> Column:
    return F.floor((F.unix_seconds(c(at).cast("timestamp")) + F.lit(EPOCH_S)) / F.lit(span_s))


def first_touch(searches: DataFrame, tree: list[DataFrame], at: str, up: Column, level: Column, interval_s: int = 86400, inclusive: bool = False,
                out: str = "touch_ts") -> DataFrame:
    """``first_touches`` of one level."""
    return first_touches(searches, tree, at, {out: (up, level)}, interval_s, inclusive)


def first_touches(searches: DataFrame, tree: list[DataFrame], at: str, wanted: dict[str, tuple[Column, Column]], interval_s: int = 86400,
                  inclusive: bool = False) -> DataFrame:
    """For each ``out -> (up, level)`` adds the time of the first bar of a ``touch_tree`` after ``at`` (or at it, ``inclusive``) with high >= level where
    ``up``, else low <= level, however far off; NULL where there is none, or no ``at``.

    The own node of the lowest level is asked first, most searches end there; the others go up until a node touches and down to its bar. A search
    meets one bounded row per level, never the history, and all levels wanted share the way up. A search carries its place only (time, node, level) and,
    when it is not asking, a key of its own that no node has, so those spread."""
    depth, own = len(tree), F.unix_micros(c(at).cast("timestamp"))
    ts_type, ids = tree[0].schema["_kids"].dataType.elementType["ts"].dataType, range(len(wanted))
    levels = [level for _, level in wanted.values()]
    df = searches.withColumns({f"_up{i}": up for i, (up, _) in enumerate(wanted.values())})
    df = df.withColumns({x: v for i in ids for x, v in ((f"_t{i}", F.lit(None).cast(ts_type)), (f"_id{i}", F.lit(None).cast("long")), (f"_at{i}", F.lit(0)))})
    idle = -1 - F.pmod(F.xxhash64(own, *levels), F.lit(1 << 30))

    def touches(i: int):
        return lambda k: F.when(c(f"_up{i}"), k["hi"] >= levels[i]).otherwise(k["lo"] <= levels[i])

    def ask(df: DataFrame, n: int, asking: dict[int, Column], node: Column, fits) -> DataFrame:
        any_asks = F.lit(False)
        for x in asking.values():
            any_asks = any_asks | x
        df = df.withColumn("_p", F.when(any_asks, node).otherwise(idle)).join(tree[n - 1], ["ticker", "_p"], "left")
        df = df.withColumns({f"_new{i}": F.when(x, F.try_element_at(F.filter("_kids", fits(i)), F.lit(1))) for i, x in asking.items()}).drop("_kids", "_p")
        found = {i: c(f"_new{i}").isNotNull() for i in asking}
        return df.withColumns({x: v for i in asking for x, v in (
            (f"_t{i}", F.when(found[i], c(f"_new{i}.ts")).otherwise(c(f"_t{i}"))), (f"_id{i}", F.when(found[i], c(f"_new{i}.id")).otherwise(c(f"_id{i}"))),
            (f"_at{i}", F.when(found[i], F.lit(n)).otherwise(c(f"_at{i}"))))}).drop(*[f"_new{i}" for i in asking])

    for n in range(1, depth + 1):
        here = own if n == 1 else _clock(at, interval_s * FANOUT ** (n - 1))
        later = (lambda k: k["id"] >= here) if n == 1 and inclusive else (lambda k: k["id"] > here)
        df = ask(df, n, {i: (c(f"_at{i}") == 0) & c(at).isNotNull() for i in ids}, _clock(at, interval_s * FANOUT ** n), lambda i: lambda k: later(k) & touches(i)(k))
    for n in range(depth - 1, 0, -1):
        for i in ids:
            df = ask(df, n, {i: c(f"_at{i}") == n + 1}, c(f"_id{i}"), touches)
    df = df.withColumns({out: c(f"_t{i}") for i, out in enumerate(wanted)})
    return df.drop(*[f"{x}{i}" for i in ids for x in ("_up", "_t", "_id", "_at")])


def touches_by_ticker(trades: DataFrame, bars: DataFrame, buy: Column, horizon_s: int | None = None) -> DataFrame:
    """Adds trigger_ts (entry), stop_ts (stop_loss) and target_ts (target) as two rounds of ``first_touches`` give them, for bars of which a block holds any ticker's
    (``series.short_clock``): bars and trades are shuffled once by ticker and pass sorted through Arrow. A task holds the bars of one ticker and a batch of trades; a
    search skips 2^k bars at a time by the highest high and lowest low of as many."""
    kept = trades.columns
    rows = trades.withColumns({"_bar": F.lit(False), "_buy": buy}).unionByName(bars.select(
        "ticker", "ts", F.lit(True).alias("_bar"), c("high").alias("_high"), c("low").alias("_low")), allowMissingColumns=True)
    rows = S.spread(rows.repartition("ticker"), bars, "ticker").sortWithinPartitions("ticker", c("_bar").desc(), "ts")
    ts = bars.schema["ts"].dataType
    schema = T.StructType([*trades.schema, *[T.StructField(x, ts) for x in ("trigger_ts", "stop_ts", "target_ts")]])
    return rows.mapInArrow(_toucher(kept, None if horizon_s is None else horizon_s * 1_000_000), schema)


def _toucher(kept: list[str], horizon: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def values(batch, name, missing):
        col = batch.column(batch.schema.get_field_index(name))
        return col.cast(pa.int64() if name == "ts" else pa.float64()).fill_null(missing).to_numpy(zero_copy_only=False)

    def tables(x):
        """Level k: the highest of the 2^k values from each on, as far as there are any."""
        out = [x]
        while 1 << (len(out) - 1) < len(x):
            last, half = out[-1], 1 << (len(out) - 1)
            out.append(np.concatenate([np.maximum(last[:-half], last[half:]), last[-half:]]))
        return out

    def search(levels, start, least):
        n, at = len(levels[0]), start
        for k in range(len(levels) - 1, -1, -1):
            there = at < n
            skip = there & ~(levels[k][np.where(there, at, 0)] >= least)
            at = np.where(skip, np.minimum(at + (1 << k), n), at)
        return at

    def run(batches):
        ticker, parts, index = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(batch.schema.get_field_index("ticker")).to_numpy(zero_copy_only=False)
            is_bar = batch.column(batch.schema.get_field_index("_bar")).to_numpy(zero_copy_only=False)
            time, high, low = values(batch, "ts", 0), values(batch, "_high", -np.inf), -values(batch, "_low", np.inf)
            high, low = np.where(np.isnan(high), np.inf, high), np.where(np.isnan(low), -np.inf, low)
            dated = batch.column(batch.schema.get_field_index("ts")).is_valid().to_numpy(zero_copy_only=False)
            up = values(batch, "_buy", 0) > 0
            want = {x: values(batch, x, np.nan) for x in ("entry", "stop_loss", "target")}
            hits = np.zeros((3, batch.num_rows), np.int64), np.zeros((3, batch.num_rows), bool)
            cuts = np.flatnonzero((names[1:] != names[:-1]) | (is_bar[1:] != is_bar[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if names[a] != ticker or names[a] is None:
                    ticker, parts, index = names[a], [], None
                if is_bar[a]:
                    parts.append([x[a:b][dated[a:b]] for x in (time, high, low)])
                    continue
                if ticker is None or not parts:
                    continue
                if index is None:
                    bar, *sides = [np.concatenate(x) for x in zip(*parts)]
                    index = bar, [tables(x) for x in sides]
                bar, sides = index
                own, rising, n = slice(a, b), up[a:b], len(bar)

                def touch(rising, level, start):
                    at = np.where(rising, search(sides[0], start, level), search(sides[1], start, -level))
                    return np.where(np.isnan(level), n, at)
                trigger = touch(rising, want["entry"][own], np.searchsorted(bar, time[own], "right"))
                trigger = np.where(dated[own], trigger, n)
                if horizon is not None:
                    trigger = np.where(np.append(bar, 0)[trigger] <= time[own] + horizon, trigger, n)
                found = [trigger, touch(~rising, want["stop_loss"][own], trigger), touch(rising, want["target"][own], trigger)]
                for i, at in enumerate(found):
                    hits[0][i, own], hits[1][i, own] = np.append(bar, 0)[at], at < n
            rest = ~is_bar
            if rest.any():
                trades, kind = batch.filter(pa.array(rest)), batch.schema.field("ts").type
                arrays = [trades.column(trades.schema.get_field_index(x)) for x in kept]
                arrays += [pa.array(hits[0][i][rest], pa.int64(), mask=~hits[1][i][rest]).cast(kind) for i in range(3)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "trigger_ts", "stop_ts", "target_ts"])
    return run


def latest_rows(df: DataFrame, keep: list[str]) -> DataFrame:
    """Latest row per ticker (combines map-side, no sort)."""
    return df.groupBy("ticker").agg(F.max_by(F.struct("ts", *keep), "ts").alias("_x")).select("ticker", "_x.*")


def with_config(df: DataFrame, config: DataFrame, on: str, defaults: dict) -> DataFrame:
    """Left lookup of per-key settings with a default row. Whether ``config`` is broadcast is left to the session's size check
    (``autoBroadcastJoinThreshold``, on real sizes at run time): the caller's frame has no bound of its own."""
    df = df.join(config, on, "left")
    return df.withColumns({k: F.coalesce(c(k), F.lit(v)) for k, v in defaults.items()})
