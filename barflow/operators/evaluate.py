"""Outcomes of patterns, trades, forecasts and recommendations; reports.  These operators look ahead by design."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from barflow.functions.scalar import div, flag, pct, pick
from barflow.operators import joins as J, series as S
from barflow.operators.salting import salted_join

c = F.col
#: Horizons by the clock, in seconds.
HORIZONS = (("5min", 300), ("15min", 900), ("30min", 1800), ("1hour", 3600), ("2hour", 7200))


def add_futures(bars: DataFrame, interval_s: int = 900, strict: bool = False) -> DataFrame:
    """Close, highest high and lowest low of the bars within the next 5 to 120 minutes and to the end of the session, unblocked; NULL where there are
    none (a horizon shorter than the bars has none).

    Not strict: a horizon longer than what is left takes what is left; strict: the series must reach its end."""
    key = Window.partitionBy("ticker", F.to_date("ts"))
    rest = key.orderBy(c("ts").desc()).rowsBetween(Window.unboundedPreceding, -1)
    df = bars.withColumns({"eod_n": F.count(F.lit(1)).over(rest), "eod_close": F.first("close").over(rest),
                           "eod_high": F.max("high").over(rest), "eod_low": F.min("low").over(rest)})
    df = S.blocked(df, interval_s)
    if strict:      # a block holds the bars ahead of its own, so it ends later than they do unless the series ends
        df = df.withColumn("_end", F.max("ts").over(Window.partitionBy("ticker", S.BLK)))
    for name, seconds in HORIZONS:
        w = S.clock_ahead(seconds, interval_s)
        ok = c("_end") >= c("ts") + F.make_dt_interval(secs=F.lit(seconds)) if strict else F.lit(True)
        df = df.withColumns({f"{name}_n": F.count(F.lit(1)).over(w), f"{name}_close": F.when(ok, F.last("close").over(w)),
                             f"{name}_high": F.when(ok, F.max("high").over(w)), f"{name}_low": F.when(ok, F.min("low").over(w))})
    return S.unblock(df).drop("_end")


def pattern_outcomes(events: DataFrame, threshold: Column | float = 0.1, neutral_inside: bool = False) -> DataFrame:
    """One row per event and horizon (needs add_futures, direction, price): change, best and worst move, success; NULL metrics where no bar follows.

    Neutral events have no success, or succeed inside the threshold with ``neutral_inside``."""
    names = [n for n, _ in HORIZONS] + ["eod"]
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    rows = F.array(*[F.struct(F.lit(n).alias("horizon"), c(f"{n}_close").alias("final"), c(f"{n}_high").alias("hi"), c(f"{n}_low").alias("lo"))
                     for n in names])
    keep = [x for x in events.columns if not any(x.startswith(f"{n}_") for n in names)]
    df = events.select(*keep, F.explode(rows).alias("_h")).select(*keep, "_h.*")
    p, bull, bear = c("price"), c("direction") == "bullish", c("direction") == "bearish"
    df = df.withColumns({"change": pct(c("final"), p), "_up": pct(c("hi"), p), "_dn": div(p - c("lo"), p) * 100})
    neutral = pick((F.abs(c("change")) <= t, 1), default=0) if neutral_inside else F.lit(None).cast("int")
    met = lambda x: F.when(c("final").isNotNull(), x)
    return df.withColumns({
        "max_favorable": pick((bull, c("_up")), (bear, c("_dn")), default=F.abs(c("change"))),
        "max_adverse": met(pick((bull, c("_dn")), (bear, c("_up")), default=0.0)),
        "success": met(pick((bull, flag(c("change") > t)), (bear, flag(c("change") < -t)), default=neutral))}).drop("_up", "_dn", "hi", "lo")


def win_rates(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """``total`` counts events with an outcome, ``open`` those without."""
    return outcomes.groupBy(*keys).agg(F.count("final").alias("total"), F.count_if(c("final").isNull()).alias("open"), F.coalesce(F.avg("success") * 100, F.lit(0.0)).alias("win_rate"),
                                       F.avg("change").alias("avg_change"), F.avg("max_favorable").alias("avg_favorable"),
                                       F.avg("max_adverse").alias("avg_adverse"))


def trade_outcomes(trades: DataFrame, bars: DataFrame, now: Column, horizon_s: int | None = None, interval_s: int = S.DAY,
                   expiry_s: int = S.DAY) -> DataFrame:
    """Status of each trade (action, entry, stop_loss, target): pending, triggered, hit_target, hit_stop or expired.

    The first touch in time after the trigger decides; both in one bar count as the stop. Trades are followed to the end of the bars,
    or for ``horizon_s`` if it is given."""
    buy = F.coalesce(c("action") == "BUY", F.lit(False))
    near = lambda x: c(x) if horizon_s is None else F.when(c(x) <= c("ts") + F.make_dt_interval(secs=F.lit(horizon_s)), c(x))
    if S.short_clock(bars, interval_s):
        df = J.touches_by_ticker(trades, bars, buy, horizon_s)
    else:
        tree = J.touch_tree(bars, interval_s)
        df = J.first_touch(trades, tree, "ts", buy, c("entry"), interval_s, out="trigger_ts").withColumn("trigger_ts", near("trigger_ts"))
        df = J.first_touches(df, tree, "trigger_ts", {"stop_ts": (~buy, c("stop_loss")), "target_ts": (buy, c("target"))}, interval_s, True)
    df = df.withColumns({"stop_ts": near("stop_ts"), "target_ts": near("target_ts")})
    old = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(c("ts").cast("timestamp")) > expiry_s
    status = pick((c("trigger_ts").isNull() & old, "expired"), (c("trigger_ts").isNull(), "pending"),
                  (c("stop_ts").isNotNull() & (c("target_ts").isNull() | (c("stop_ts") <= c("target_ts"))), "hit_stop"),
                  (c("target_ts").isNotNull(), "hit_target"), default="triggered")
    return df.withColumn("status", status)


def tracker_summary(outcomes: DataFrame) -> DataFrame:
    st = c("status")
    g = outcomes.groupBy("ticker").agg(F.count(F.lit(1)).alias("total"), *[
        F.count_if(st == s).alias(s) for s in ("pending", "triggered", "hit_target", "hit_stop", "expired")])
    return g.withColumn("win_rate", F.coalesce(div(c("hit_target") * 100.0, c("hit_target") + c("hit_stop")), F.lit(0.0)))


def forecast_evaluation(preds: DataFrame, bars: DataFrame, threshold: float, interval_s: int = 900) -> DataFrame:
    """Predictions (ticker, ts, price, pred_pct, direction) against the first bar at or after +1 h, +3 h and 16:00. Where no bar has come yet the actual
    values, ``correct`` and ``error`` are NULL."""
    close = F.date_trunc("day", "ts").cast(preds.schema["ts"].dataType) + F.expr("INTERVAL 16 HOURS")
    targets = F.array(F.struct(F.lit("1h").alias("horizon"), (c("ts") + F.expr("INTERVAL 1 HOUR")).alias("target")),
                      F.struct(F.lit("3h").alias("horizon"), (c("ts") + F.expr("INTERVAL 3 HOURS")).alias("target")),
                      F.struct(F.lit("eod").alias("horizon"), close.alias("target")))
    df = preds.withColumn("_t", F.explode(targets)).withColumns({"horizon": c("_t.horizon"), "target": c("_t.target")}).drop("_t")
    df = J.asof_join(df, bars, "target", ["close"], "forward", interval_s)
    df = df.withColumn("actual_pct", pct(c("hit.close"), c("price")))
    known = c("actual_pct").isNotNull()
    actual = F.when(known, pick((c("actual_pct") > threshold, "BULLISH"), (c("actual_pct") < -threshold, "BEARISH"), default="NEUTRAL"))
    return df.withColumns({"actual_direction": actual, "correct": F.when(known, flag(c("direction") == actual)),
                           "error": F.abs(c("pred_pct") - c("actual_pct"))}).drop("hit", "target")


def accuracy(evals: DataFrame) -> DataFrame:
    """Accuracy overall and per predicted direction, and the error range, by ticker and horizon. ``total`` counts predictions that have been evaluated,
    ``open`` the others."""
    return evals.groupBy("ticker", "horizon").agg(
        F.count("correct").alias("total"), F.count_if(c("correct").isNull()).alias("open"), (F.avg("correct") * 100).alias("accuracy"), F.avg("error").alias("avg_error"), F.min("error").alias("min_error"),
        F.max("error").alias("max_error"), *[F.coalesce(F.avg(F.when(c("direction") == d, c("correct"))) * 100, F.lit(0.0)).alias(f"{d.lower()}_accuracy")
                                             for d in ("BULLISH", "BEARISH", "NEUTRAL")])


def recommendation_report(recs: DataFrame, bars: DataFrame, hours: int, threshold: float, interval_s: int = 900) -> DataFrame:
    """Recommendations (ticker, ts, price, recommendation) against the first bar ``hours`` later; accuracy by side."""
    df = recs.withColumn("target", c("ts") + F.make_dt_interval(hours=F.lit(hours)))
    df = J.asof_join(df, bars, "target", ["close"], "forward", interval_s).withColumn("change", pct(c("hit.close"), c("price")))
    known = c("change").isNotNull()
    buy, sell, hold = c("recommendation").isin("BUY", "STRONG BUY"), c("recommendation").isin("SELL", "STRONG SELL"), c("recommendation") == "HOLD"
    df = df.withColumn("ok", F.when(known, flag((buy & (c("change") > threshold)) | (sell & (c("change") < -threshold)) | (hold & (F.abs("change") <= threshold)))))
    zero, sides = F.lit(0.0), (("buy", buy), ("sell", sell), ("hold", hold))
    return df.groupBy("ticker").agg(
        F.count("ok").alias("total"), F.count_if(~known).alias("open"), F.sum("ok").alias("correct"), (F.avg("ok") * 100).alias("accuracy"),
        F.avg("change").alias("avg_change"), *[F.coalesce(F.avg(F.when(x, c("ok"))) * 100, zero).alias(f"{n}_accuracy") for n, x in sides],
        *[F.count_if(x & known).alias(f"{n}_count") for n, x in sides])


def fitted_signals(rows: DataFrame, lookback_days: int = 90, test_days: int = 20, min_train_days: int = 60, cost: float = 0.0) -> DataFrame:
    """Walk-forward signals of a rule that is fitted anew for each test window of ``test_days``: the least-squares line of next_ret on feature over the
    ``lookback_days`` before the window, ``min_train_days`` at least; a bar is bought or sold where the line promises more than ``cost``.

    ``rows``: ticker, ts, feature, next_ret, next_ts. A pair is learnt from once its next bar is known, so on the day of next_ts. The sums that the line
    needs are kept per stretch of days that divides all three lengths, and a window adds up those of its training days: no row is read twice.
    Windows without two different features to learn from have signal 0. Adds ``split`` and ``signal``; rows before the first window are left out. Where ``rows`` have
    ``first_ts``, the first time of their ticker, nothing is joined to find it, and rows that lie by ticker stay where they are."""
    step = math.gcd(lookback_days, test_days, min_train_days)
    if "first_ts" in rows.columns:
        df = rows.withColumnRenamed("first_ts", "_t0")
    else:
        df = salted_join(rows, rows.groupBy("ticker").agg(F.min("ts").alias("_t0")), ["ticker"], ["ts"])
    x, y = c("feature"), c("next_ret")
    n, names = F.when(x.isNotNull() & y.isNotNull(), F.lit(1).cast("long")), ("_n", "_x", "_y", "_xy", "_xx")
    own = F.struct(F.floor(F.datediff("next_ts", "_t0") / step).alias("_d"), n.alias("_n"), *[(v * n).alias(k) for k, v in zip(names[1:], (x, y, x * y, x * x))])
    #: every window's first stretch is there, with sums of its own or without; one pass gives both
    start = F.floor((F.floor(F.datediff("ts", "_t0") / step) * step - min_train_days) / test_days) * test_days + min_train_days
    first = F.struct(F.floor(start / step).alias("_d"), F.lit(0).cast("long").alias("_n"), *[F.lit(0.0).alias(k) for k in names[1:]])
    stretches = F.array(F.when(n == 1, own), F.when(start >= min_train_days, first))
    known = df.select("ticker", F.explode(F.filter(stretches, lambda s: s.isNotNull())).alias("_s")).select("ticker", "_s.*")
    known = known.groupBy("ticker", "_d").agg(*[F.sum(k).alias(k) for k in names])
    w = Window.partitionBy("ticker").orderBy("_d").rangeBetween(-(lookback_days // step), -1)       # one row per stretch of days
    known = known.select("ticker", "_d", *[F.sum(k).over(w).alias(k) for k in names])
    spread = c("_n") * c("_xx") - c("_x") * c("_x")
    slope = F.when((c("_n") >= 2) & (spread > 1e-12 * c("_n") * c("_xx")), (c("_n") * c("_xy") - c("_x") * c("_y")) / spread)
    rules = known.select("ticker", ((c("_d") * step - min_train_days) / test_days).alias("_f"), slope.alias("slope"), ((c("_y") - slope * c("_x")) / c("_n")).alias("base")) \
        .filter(c("_f") == F.floor("_f")).select("ticker", c("_f").cast("int").alias("split"), "slope", "base")
    day = F.datediff("ts", "_t0") - min_train_days
    test = df.filter(day >= 0).withColumn("split", F.floor(day / test_days).cast("int")).drop("_t0")
    promise = c("base") + c("slope") * x
    return test.join(rules, ["ticker", "split"], "left").withColumn("signal", F.coalesce(pick((promise > cost, 1), (promise < -cost, -1), default=0), F.lit(0))) \
        .drop("slope", "base")


def walk_forward(signals: DataFrame, cost: float = 0.0) -> DataFrame:
    """Metrics of each test window (ticker, split, ts, signal, next_ret; see ``fitted_signals``). ``cost`` is paid for each unit by which the position
    changes. A return of -100 % or less ends the equity at zero."""
    along = Window.partitionBy("ticker", "split").orderBy("ts")       # a window's days bound it
    df = signals.filter(c("next_ret").isNotNull()).withColumn("_turn", F.abs(c("signal") - F.coalesce(F.lag("signal").over(along), F.lit(0))))
    df = df.withColumn("_r", F.greatest(c("signal") * c("next_ret") - c("_turn") * cost, F.lit(-1.0 + 1e-12)))
    w = along.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_eq", F.exp(F.sum(F.log1p("_r")).over(w)))
    df = df.withColumn("_dd", c("_eq") / F.greatest(F.max("_eq").over(w), F.lit(1.0)) - 1)
    traded = c("signal") != 0
    return df.groupBy("ticker", "split").agg(
        F.count(F.lit(1)).alias("bars"), F.count_if(traded).alias("trades"), (F.exp(F.sum(F.log1p("_r"))) - 1).alias("total_return"),
        (div(F.avg("_r"), F.stddev_samp("_r")) * F.sqrt(F.lit(252.0))).alias("sharpe"), F.min("_dd").alias("max_drawdown"),
        F.avg(F.when(traded, flag(c("_r") > 0))).alias("win_rate"),
        div(F.sum(F.when(c("_r") > 0, c("_r")).otherwise(0.0)), F.sum(F.when(c("_r") < 0, -c("_r")).otherwise(0.0))).alias("profit_factor"))


def sampled_backtest(bars: DataFrame, step: int, interval_s: int = 900) -> DataFrame:
    """Every ``step``-th bar as a prediction point: momentum of 4 bars against the next 4 and 12 bars."""
    df = S.blocked(bars, interval_s)
    df = df.withColumns({"pred_pct": pct(c("close"), S.lag("close", 4)), "actual_1h": pct(S.lead("close", 4), c("close")),
                         "actual_3h": pct(S.lead("close", 12), c("close"))})
    return S.unblock(df.filter(c(S.POS) % step == 0)).filter(c("pred_pct").isNotNull())


def rating(acc: DataFrame) -> DataFrame:
    """Mean accuracy, best horizon and a rating per ticker."""
    g = acc.groupBy("ticker").agg(F.avg("accuracy").alias("overall"), F.max_by("horizon", F.struct("accuracy", "horizon")).alias("best_horizon"))
    return g.withColumn("rating", pick((c("overall") >= 50, "EXCELLENT"), (c("overall") >= 45, "GOOD"), (c("overall") >= 40, "FAIR"),
                                       default="NEEDS_IMPROVEMENT"))


def performance_trend(history: DataFrame, last: int = 5, points: float = 2.0) -> DataFrame:
    """First against last accuracy of the newest ``last`` evaluations per (ticker, horizon)."""
    w = Window.partitionBy("ticker", "horizon").orderBy(c("ts").desc())
    t = history.withColumn("_rn", F.row_number().over(w)).filter(c("_rn") <= last)
    g = t.groupBy("ticker", "horizon").agg(F.min_by("accuracy", "ts").alias("first"), F.max_by("accuracy", "ts").alias("last"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("trend", pick((c("n") < 2, "stable"), (c("last") > c("first") + points, "improving"), (c("last") < c("first") - points, "declining"),
                                      default="stable"))


def latest_within(preds: DataFrame, hours: int = 6) -> DataFrame:
    """Newest prediction per ticker no older than ``hours`` against the newest row of the table."""
    newest = preds.agg(F.max("ts").alias("_now"))
    rest = [x for x in preds.columns if x != "ticker"]
    df = preds.crossJoin(F.broadcast(newest)).filter(c("ts") >= c("_now") - F.make_dt_interval(hours=F.lit(hours)))
    return df.groupBy("ticker").agg(F.max_by(F.struct(*rest), F.struct("ts", *[x for x in rest if x != "ts"])).alias("_x")).select("ticker", "_x.*")


def flatten_metrics(df: DataFrame, metrics: str = "metrics") -> DataFrame:
    """A map of metrics per horizon -> one row per (ticker, horizon, metric)."""
    df = df.select("ticker", F.explode(metrics).alias("horizon", "_m"))
    return df.select("ticker", "horizon", F.explode("_m").alias("metric", "value"))
