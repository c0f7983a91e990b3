"""Nearest-pattern forecasts.

A library row is a window of closes (or returns) with what followed.  The current windows are few per ticker (one, or
the bars of one session) and meet the library by an equi-join on (ticker, slice of the clock); the library itself is never gathered.

Few pairs are compared in full. Each window also carries the means of its segments, and for positive weights the weighted distance
of those means is a lower bound of the distance itself (Cauchy and Schwarz, segment by segment). The closest bound of each of ``CELLS``
times k cells of the library gives rows enough to know an upper bound of the k-th distance; pairs whose lower bound exceeds it
are out, the rest are ranked exactly. Cells are minima of a hash aggregation, so no pair is sorted before the last few."""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from barflow.functions.scalar import clamp, div, flag, pick
from barflow.operators import indicators as I, series as S
from barflow.operators.salting import salted_join

c = F.col
HORIZONS = ("h1", "h3", "eod")


def window(x: str, n: int, over: WindowSpec) -> dict[str, Column]:
    """The values of a window of n rows with their mean and population deviation."""
    return {"_w": F.collect_list(x).over(over), "_m": F.avg(x).over(over), "_sd": F.stddev_pop(x).over(over)}


def zscored(arr: str) -> Column:
    """Window minus its mean (_m) over its population deviation (_sd); NULL for a flat window."""
    return F.when(c("_sd") > 1e-12, F.transform(arr, lambda x: (x - c("_m")) / c("_sd")))


def _total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def decay_weights(n: int, rate: float = 0.1, focus: int = 3) -> list[float]:
    """Emphasis e^(rate*(focus-i)) on the last ``focus`` bars, rescaled to sum n."""
    w = [1.0] * n
    for i in range(min(focus, n)):
        w[n - 1 - i] *= math.exp(rate * (focus - i))
    return [x * n / sum(w) for x in w]


def exponential_weights(n: int, rate: float = 0.1, decay: str = "recent") -> list[float]:
    """Weights e^(-rate*age) summing to 1; decay='oldest' puts the emphasis on the other end."""
    w = [math.exp(-rate * (n - 1 - i)) for i in range(n)]
    if decay == "oldest":
        w.reverse()
    return [x / sum(w) for x in w]


def split_last(bars: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(all but the last n bars, the last n bars) of each ticker."""
    w = Window.partitionBy("ticker").orderBy(c("ts").desc())
    cut = bars.select("ticker", "ts").withColumn("_rn", F.row_number().over(w)).filter(c("_rn") <= n) \
        .groupBy("ticker").agg(F.min("ts").alias("_cut"))
    j = salted_join(bars, cut, ["ticker"], ["ts"])
    return j.filter(c("ts") < c("_cut")).drop("_cut"), j.filter(c("ts") >= c("_cut")).drop("_cut")


def session_library(bars: DataFrame, n: int, step: int = 1, per_hour: int = 4) -> DataFrame:
    """Windows of n closes inside a session, ``step`` apart, with 1 h, 3 h and end-of-session returns.

    A session needs n bars and an hour ahead; three hours ahead are kept free where the session is long enough."""
    key = Window.partitionBy("ticker", "date")
    ws = key.orderBy("ts")
    df = bars.select("ticker", "ts", "close", F.to_date("ts").alias("date"))
    df = df.withColumns({
        "_no": F.row_number().over(ws) - 1, "_n": F.count(F.lit(1)).over(key),
        **window("close", n, ws.rowsBetween(-(n - 1), 0)), "_h1": F.lead("close", per_hour).over(ws), "_h3": F.lead("close", 3 * per_hour).over(ws),
        "_eod": F.last("close").over(ws.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    start = c("_no") - (n - 1)
    room = F.when(c("_n") >= n + 3 * per_hour, 3 * per_hour).otherwise(per_hour)
    ok = (c("_n") >= n + per_hour) & (start >= 0) & (start < c("_n") - n - room) & (start % step == 0)
    return df.filter(ok).select("ticker", "ts", zscored("_w").alias("shape"), *[
        (div(c(f"_{h}"), c("close")) - 1).alias(h) for h in HORIZONS]).filter(c("shape").isNotNull())


def cross_library(bars: DataFrame, n: int = 20, ahead=(4, 12, 26), interval_s: int = 900, room: int = 20) -> DataFrame:
    """Windows of n closes across sessions; returns run from the bar after the window, ``room`` bars must follow that one."""
    df = S.blocked(bars, interval_s)
    df = df.withColumns({**window("close", n, S.w(n, 1)), "_end": S.lag("ts"), "_room": S.lead("close", room),
                         **{f"_{h}": S.lead("close", k) for h, k in zip(HORIZONS, ahead)}})
    df = S.unblock(df.filter((c(S.POS) >= n) & c("_room").isNotNull()))
    return df.select("ticker", c("_end").alias("ts"), zscored("_w").alias("shape"), *[
        (div(c(f"_{h}"), c("close")) - 1).alias(h) for h in HORIZONS]).filter(c("shape").isNotNull())


def regime_library(bars: DataFrame, regimes: DataFrame, n: int = 20, ahead: tuple[int, int, int] = (4, 12, 24), interval_s: int = 900) -> DataFrame:
    """Windows of the n closes before each bar whose regime (ticker, ts, regime) is known. Returns run from the last close of the window to the bars ``ahead``
    of the bar after it; the middle one must exist, the longest ends with the data at the latest. Regimes join the bars, which are narrow, not the windows."""
    df = S.blocked(bars.select("ticker", "ts", "close").join(regimes.select("ticker", "ts", "regime", F.lit(True).alias("_known")), ["ticker", "ts"], "left"), interval_s)
    h1, h3, eod = ahead
    df = df.withColumns({**window("close", n, S.w(n, 1)), "_base": S.lag("close"), "_h1": S.lead("close", h1), "_h3": S.lead("close", h3),
                         "_eod": F.last("close").over(S.ahead(0, eod))})
    df = S.unblock(df.filter((c(S.POS) >= n) & c("_h3").isNotNull() & c("_known")))
    return df.select("ticker", "ts", "regime", zscored("_w").alias("shape"), *[
        (div(c(f"_{h}"), c("_base")) - 1).alias(h) for h in HORIZONS]).filter(c("shape").isNotNull())


def last_bars(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars of each ticker (n per ticker and task meet, the rest is dropped before the shuffle)."""
    w = Window.partitionBy("ticker").orderBy(c("ts").desc())
    return bars.withColumn("_rn", F.row_number().over(w)).filter(c("_rn") <= n).drop("_rn")


def current_shape(last: DataFrame, n: int) -> DataFrame:
    """One query row per ticker from its last n bars (n values per ticker, bounded)."""
    g = last.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("ts", "close"))).alias("_b"), F.max_by("close", "ts").alias("price"),
                                   F.avg("close").alias("_m"), F.stddev_pop("close").alias("_sd"))
    g = g.filter(F.size("_b") == n).withColumn("_w", F.transform("_b", lambda x: x["close"]))
    return g.select("ticker", "price", zscored("_w").alias("query")).filter(c("query").isNotNull())


def distance(a: str, b: str, weights: list[float] | None = None) -> Column:
    sq = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    if weights:
        sq = F.zip_with(sq, F.array(*[F.lit(w) for w in weights]), lambda s, w: s * w)
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, v: acc + v))


#: Segments of a window in the lower bound, cells of the library for each neighbour wanted, rows of a slice of the clock.
SEGMENTS, CELLS, SLICE_ROWS = 5, 4, 4096


def _segments(n: int) -> list[range]:
    cuts = [round(i * n / SEGMENTS) for i in range(SEGMENTS + 1)]
    return [range(x, y) for x, y in zip(cuts, cuts[1:]) if y > x]


def segment_means(arr: str, n: int, weights: list[float] | None = None) -> list[Column]:
    """Weighted mean of each segment of an array."""
    w, out = weights or [1.0] * n, []
    for seg in _segments(n):
        part, own = F.slice(arr, F.lit(seg.start + 1), F.lit(len(seg))), [w[i] / sum(w[j] for j in seg) for i in seg]
        out.append(F.aggregate(F.zip_with(part, F.array(*map(F.lit, own)), lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v))
    return out


def lower_bound(n: int, weights: list[float] | None = None) -> Column:
    """Distance of the segment means (_l0.. of the library, _q0.. of the query): never more than the windows' own ``distance``. Written out, so
    that it is compiled: this is what every pair pays."""
    w = weights or [1.0] * n
    return F.sqrt(_total([(c(f"_l{k}") - c(f"_q{k}")) * (c(f"_l{k}") - c(f"_q{k}")) * F.lit(sum(w[i] for i in seg)) for k, seg in enumerate(_segments(n))]))


def _compared(library: DataFrame, queries: DataFrame, k: int, n: int, weights: list[float] | None, by: tuple[str, ...], scale: Column | None,
              only: Column | None, times: DataFrame | None, interval_s: int) -> tuple[DataFrame, DataFrame]:
    """(``by``, _limit, library_size: an upper bound of the k-th distance, NULL where fewer than k cells have rows, and the number of pairs;
    the pairs whose lower bound is within it, with ``dist``)."""
    slice_ = F.floor(F.unix_seconds(c("ts").cast("timestamp")) / F.lit(interval_s * SLICE_ROWS)).alias("_slice")
    #: one shuffle of the library, into slices of at most SLICE_ROWS rows; both passes read it
    lib = library.select("*", slice_, *[x.alias(f"_l{k}") for k, x in enumerate(segment_means("shape", n, weights))]).repartition("ticker", "_slice")
    slices = (library if times is None else times).select("ticker", slice_).distinct()
    asked = queries.withColumns({f"_q{k}": x for k, x in enumerate(segment_means("query", n, weights))})
    scale = F.lit(1.0) if scale is None else scale

    def pairs(q: DataFrame) -> DataFrame:
        j = lib.join(q.join(slices, "ticker"), ["ticker", "_slice"])
        return (j if only is None else j.filter(only)).withColumn("_lb", lower_bound(n, weights) * scale)

    first = pairs(asked)
    rest = [x for x in first.columns if x not in by]
    cells = first.groupBy(*by, F.pmod(F.xxhash64("ts"), F.lit(CELLS * k)).alias("_cell")).agg(
        F.min_by(F.struct(*rest), F.struct("_lb", "ts")).alias("_x"), F.count(F.lit(1)).alias("_n"))
    near = cells.select(*by, "_n", "_x.*").withColumn("_d", distance("query", "shape", weights) * scale)
    limits = near.groupBy(*by).agg(F.try_element_at(F.array_sort(F.collect_list("_d")), F.lit(k)).alias("_limit"), F.sum("_n").alias("library_size"))
    room = c("_limit") * (1 + 1e-9) + 1e-12          # sums of segments and of single values differ in their last bits
    close = pairs(asked.join(limits, list(by))).filter(c("_limit").isNull() | (c("_lb") <= room))
    return limits, close.withColumn("dist", distance("query", "shape", weights) * scale)


def nearest(library: DataFrame, queries: DataFrame, k: int, n: int, weights: list[float] | None = None, by: tuple[str, ...] = ("ticker",),
            scale: Column | None = None, only: Column | None = None, times: DataFrame | None = None, interval_s: int = 900) -> DataFrame:
    """The k nearest library rows (ticker, ts, shape of n values, ...) of every query row (``by``, query, ...), ties by time, with ``dist`` and ``library_size``, the
    number of rows that a query met. ``scale`` multiplies the distance, ``only`` keeps pairs out; ``times`` (ticker, ts) has every time of the library,
    where that is cheaper to read than the library itself.

    Where a ticker's whole clock is short (``series.short_clock``), its rows are bounded and lie together: every pair is compared in full there, in one pass, and no
    window is moved."""
    if S.short_clock(library, interval_s):
        j = library.join(queries, "ticker")
        j = (j if only is None else j.filter(only)).withColumn("dist", distance("query", "shape", weights) * (F.lit(1.0) if scale is None else scale)).drop("query", "shape")
        each = Window.partitionBy(*by)
        j = j.withColumns({"_rn": F.row_number().over(each.orderBy("dist", "ts")), "library_size": F.count(F.lit(1)).over(each)})
        return j.filter(c("_rn") <= k).drop("_rn")
    _, close = _compared(library, queries, k, n, weights, by, scale, only, times, interval_s)
    close = close.filter(c("_limit").isNull() | (c("dist") <= c("_limit") * (1 + 1e-9) + 1e-12))
    w = Window.partitionBy(*by).orderBy("dist", "ts")
    j = close.withColumn("_rn", F.row_number().over(w)).filter(c("_rn") <= k)
    return j.drop("query", "shape", "_slice", "_lb", "_limit", "_rn", *[f"_{x}{k}" for x in "lq" for k in range(SEGMENTS)])


def pruning(library: DataFrame, queries: DataFrame, k: int, n: int, weights: list[float] | None = None, by: tuple[str, ...] = ("ticker",),
            interval_s: int = 900) -> DataFrame:
    """What ``nearest`` compares in full: ``by``, pairs, compared."""
    limits, close = _compared(library, queries, k, n, weights, by, None, None, None, interval_s)
    some = close.groupBy(*by).agg(F.count(F.lit(1)).alias("compared"))
    return limits.join(some, list(by), "left").select(*by, c("library_size").alias("pairs"), F.coalesce("compared", F.lit(0)).alias("compared"))


def session_forecast(bars: DataFrame, n: int, k: int, step: int = 1) -> DataFrame:
    """Inverse-distance forecast from the session library with emphasis on the last bars and a confidence score."""
    past, last = split_last(bars, n)
    lib = session_library(past, n, step)
    near = nearest(lib, current_shape(last, n), k, n, decay_weights(n), times=bars)
    near = near.withColumn("_w", 1 / (1 + c("dist")))
    g = near.groupBy("ticker").agg(
        F.first("price").alias("price"), *[div(F.sum(c("_w") * c(h)), F.sum("_w")).alias(h) for h in HORIZONS],
        F.when(F.count(F.lit(1)) > 1, 1 / (1 + F.stddev_pop("dist"))).otherwise(0.5).alias("confidence_score"), F.first("library_size").alias("library_size"))
    base = pick((c("library_size") > 10000, "HIGH"), (c("library_size") > 1000, "MEDIUM"), default="LOW")
    mod = pick((c("confidence_score") > 0.8, "+"), (c("confidence_score") < 0.3, "-"), default="")
    return g.withColumn("confidence", F.concat(base, mod))


def plain_forecast(bars: DataFrame, n: int, k: int) -> DataFrame:
    """Unweighted mean of the k nearest (no emphasis)."""
    past, last = split_last(bars, n)
    near = nearest(session_library(past, n), current_shape(last, n), k, n, times=bars)
    return near.groupBy("ticker").agg(*[F.avg(h).alias(h) for h in HORIZONS])


def cross_forecast(bars: DataFrame, n: int = 20, k: int = 10, min_confidence: float = 0.0,
                   vol_mult: float | dict[str, float] = 1.0, interval_s: int = 900) -> DataFrame:
    """Cross-session forecast: weights 1/d renormalised over present horizons, confidence from size and closeness.

    ``vol_mult``: one multiplier of the direction threshold, or a setting per ticker (1 for tickers without one)."""
    lib = cross_library(bars, n, interval_s=interval_s)
    near = nearest(lib, current_shape(last_bars(bars, n), n), k, n, exponential_weights(n), times=bars, interval_s=interval_s)
    g = near.withColumn("_w", 1 / (c("dist") + 1e-8)).groupBy("ticker").agg(
        F.avg("dist").alias("avg_distance"), F.first("library_size").alias("library_size"),
        *[div(F.sum(c("_w") * c(h)), F.sum(F.when(c(h).isNotNull(), c("_w")))).alias(h) for h in HORIZONS])
    g = g.withColumn("confidence", F.least(F.lit(1.0), c("library_size") / 100.0) / (1 + c("avg_distance")))
    t = adaptive_direction_threshold(vol_mult)
    low = c("confidence") < min_confidence
    return g.withColumns({f"{h}_dir": pick((low, "HOLD"), (c(h) > t, "BUY"), (c(h) < -t, "SELL"), default="HOLD") for h in HORIZONS})


def adaptive_direction_threshold(vol_mult: float | dict[str, float], lo: float = 0.0005, hi: float = 0.005) -> Column:
    if isinstance(vol_mult, dict):
        table = F.create_map(*[x for k, v in vol_mult.items() for x in (F.lit(k), F.lit(float(v)))])
        vol_mult = F.coalesce(F.try_element_at(table, c("ticker")), F.lit(1.0))
    return F.greatest(F.lit(lo), F.least(F.lit(hi), F.lit(lo) * vol_mult))


def multi_length_forecast(bars: DataFrame, lengths=((8, 20, 0.4), (12, 30, 0.35), (20, 50, 0.25))) -> DataFrame:
    """Forecasts of several window lengths blended by weight, renormalised over those present."""
    parts = None
    for n, k, w in lengths:
        f = session_forecast(bars, n, k).select("ticker", *HORIZONS, "confidence_score", F.lit(n).alias("n"), F.lit(w).alias("w"))
        parts = f if parts is None else parts.unionByName(f)
    longest = max(n for n, _, _ in lengths)
    return parts.groupBy("ticker").agg(*[
        F.coalesce(div(F.sum(c(h) * c("w")), F.sum(F.when(c(h).isNotNull(), c("w")))), F.lit(0.0)).alias(h) for h in HORIZONS],
        F.max(F.when(c("n") == longest, c("confidence_score"))).alias("confidence_score"))


# ---------------------------------------------------------------- momentum and return-shape models

# Settings of the two shape models.
SHAPE_MODELS = {
    "steady": dict(n=12, k=20, ahead=4, vol=20, mom=4, shape_min=0.0005, shape_gain=100.0, shape_w=2.0, mom_min=0.001, mom_gain=50.0,
                   mom_w=3.0, top=3, least=0.5),
    "fast": dict(n=8, k=15, ahead=2, vol=15, mom=2, shape_min=0.001, shape_gain=50.0, shape_w=1.5, mom_min=0.002, mom_gain=25.0,
                 mom_w=3.5, top=4, least=0.8),
}


def return_shapes(bars: DataFrame, p: dict, interval_s: int = 900) -> DataFrame:
    """Returns of the n bars before each bar over its volatility, with momentum, volume ratio and what followed."""
    n = p["n"]
    df = I.add_change(S.blocked(bars, interval_s))
    df = df.withColumns({"vol": S.std(c("ret"), p["vol"]), "_r": F.collect_list("ret").over(S.w(n, 1)), "mom": I.roc(p["mom"]),
                         "p_ret": S.lag("ret"), "volume_ratio": div(c("volume"), S.mean(c("volume"), p["vol"])),
                         "future": div(S.lead("close", p["ahead"]), c("close")) - 1,
                         "range_pct": div(c("high") - c("low"), c("close"))})
    ok = (F.size("_r") == n) & (c("vol") > 0)
    return S.unblock(df.withColumn("shape", F.when(ok, F.transform("_r", lambda x: x / c("vol"))))).filter(c("shape").isNotNull()).drop("_r")


def shape_signals(bars: DataFrame, model: str = "steady", test_bars: int = 26, interval_s: int = 900) -> DataFrame:
    """Signals for the last ``test_bars`` bars of each ticker against all bars before them.

    The current windows per ticker are ``test_bars``, a constant, so the join grows with the library only."""
    p = SHAPE_MODELS[model]
    shapes = return_shapes(bars, p, interval_s)
    lib = shapes.filter(c("future").isNotNull()).select("ticker", "ts", "shape", "future")
    test = last_bars(shapes, test_bars).withColumn("_cut", F.min("ts").over(Window.partitionBy("ticker")))      # test_bars rows per ticker
    queries = test.select("ticker", c("ts").alias("at"), c("shape").alias("query"), "_cut")
    near = nearest(lib, queries, p["k"], p["n"], by=("ticker", "at"), only=c("ts") < c("_cut"), times=bars, interval_s=interval_s)
    near = near.withColumn("_w", 1 / (c("dist") + 0.1))
    exp = near.groupBy("ticker", "at").agg((F.sum(c("_w") * c("future")) / F.sum("_w")).alias("shape_return"))
    df = test.join(exp, (test["ticker"] == exp["ticker"]) & (test["ts"] == exp["at"])).drop(exp["ticker"]).drop("at")
    s, m = c("shape_return"), F.coalesce(c("mom"), F.lit(0.0))
    strength = pick((F.abs(s) > p["shape_min"], F.signum(s) * F.least(F.abs(s) * p["shape_gain"], F.lit(1.0)) * p["shape_w"]), default=0.0) \
        + pick((F.abs(m) > p["mom_min"], F.signum(m) * F.least(F.abs(m) * p["mom_gain"], F.lit(1.0)) * p["mom_w"]), default=0.0)
    if model == "fast":
        both = (F.abs(c("ret")) > 0.01) & (F.abs(c("p_ret")) > 0.01)
        strength = strength - pick((both, F.signum(c("p_ret")) * 2.0), default=0.0)
        strength = strength * pick((c("range_pct") > 0.015, 1.3), default=1.0) \
            * pick((c("volume_ratio") > 2.0, 1.5), (c("volume_ratio") < 0.5, 0.5), default=1.0)
    else:
        strength = strength * pick((c("volume_ratio") > 1.5, 1.2), default=1.0)
    df = df.withColumns({"date": F.to_date("ts"), "strength": strength})
    w = Window.partitionBy("ticker", "date").orderBy(F.abs(c("strength")).desc(), "ts")
    df = df.withColumn("_rn", F.row_number().over(w))
    hit = (c("_rn") <= p["top"]) & (F.abs(c("strength")) >= p["least"])
    return df.withColumn("signal", F.when(hit, F.signum(c("strength")).cast("int")).otherwise(0)).select(
        "ticker", "ts", "close", "shape_return", "mom", "strength", "signal")


def momentum_fallback(signals: DataFrame, every: int = 13, least: float = 0.002) -> DataFrame:
    """Tickers without any signal take the momentum of every 13th bar where it is large enough."""
    any_ = Window.partitionBy("ticker")      # a ticker has test_bars rows here, a constant
    no = F.row_number().over(Window.partitionBy("ticker").orderBy("ts")) - 1
    df = signals.withColumns({"_any": F.max(F.abs("signal")).over(any_), "_no": no})
    use = (c("_any") == 0) & (c("_no") >= 12) & (c("_no") % every == 0) & (F.abs("mom") > least)
    return df.withColumn("signal", F.when(use, F.signum("mom").cast("int")).otherwise(c("signal"))).drop("_any", "_no")


def regime_similarity(weight: float = 0.7) -> Column:
    return pick((c("regime") == c("current_regime"), 1.0), default=1.0 - weight)


def regime_forecast(library: DataFrame, queries: DataFrame, k: int = 10, weight: float = 0.7, n: int = 20, times: DataFrame | None = None,
                    interval_s: int = 900) -> DataFrame:
    """Nearest patterns with the distance divided by the regime similarity (1, or 1 - weight for another regime)."""
    near = nearest(library, queries, k, n, scale=1 / regime_similarity(weight), times=times, interval_s=interval_s)
    w = regime_similarity(weight) / (1 + c("dist"))
    near = near.withColumn("_w", w)
    g = near.groupBy("ticker").agg(*[
        F.coalesce(div(F.sum(c("_w") * c(h)), F.sum(F.when(c(h).isNotNull(), c("_w")))), F.lit(0.0)).alias(h) for h in HORIZONS],
        F.first("current_regime").alias("current_regime"), F.avg(flag(c("regime") == c("current_regime"))).alias("match_ratio"))
    return g.withColumn("confidence", clamp(c("match_ratio") + 0.3, 0.0, 1.0))
