"""Intraday entry rules on session bars, fixed and regime-dependent, with confidence and selection."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barflow.functions.scalar import div, hour_of_day, pick
from barflow.operators import indicators as I, series as S

c = F.col
OPENING = (20, 30, 45)


def features(bars: DataFrame, interval_s: int = 900) -> DataFrame:
    """Everything the rules read: session columns by (ticker, date), rolling ones by (ticker, block)."""
    df = I.add_session(bars, 3)
    key = Window.partitionBy("ticker", "date")
    df = df.withColumns({f"{side}_{k}": fn(F.when(c("bar_no") <= k, c(col))).over(key)
                         for k in OPENING for side, fn, col in (("orh", F.max, "high"), ("orl", F.min, "low"))})
    df = df.withColumn("last_of_session", c("bar_no") == F.max("bar_no").over(key))
    df = I.add_change(S.blocked(df, interval_s))
    df = df.withColumns({"atr": S.mean(c("tr"), 14), "avg_vol": S.mean(c("volume"), 20), "p_low": S.lag("low"),
                         "low_10": F.min("low").over(S.w(10, 1)), "low_15": F.min("low").over(S.w(15, 1))})
    df = I.add_rsi_sma(df, 14)
    df = S.ewm(df, {f"ema_{n}": (c("close"), S.span(n), True) for n in (9, 20, 21)})
    df = I.add_adx(df)
    df = df.withColumn("regime", regime())
    return S.unblock(df.withColumn("pos", c(S.POS)))


def regime() -> Column:
    """ADX decides first, then ATR relative to price."""
    rel = div(c("atr"), c("close"))
    return pick((c(S.POS) < 19, "unknown"), (c("adx") > 30, "trending"), (c("adx") < 20, "ranging"), (rel > 0.02, "volatile"),
                (rel < 0.01, "quiet"), default="normal")


def _signal(cond: Column, name: str, entry: Column, stop: Column, target: Column, confidence: Column) -> Column:
    return F.when(cond, F.struct(F.lit(name).alias("strategy"), F.lit("LONG").alias("direction"), entry.alias("entry"),
                                 stop.alias("stop"), target.alias("target"), confidence.cast("double").alias("confidence")))


def fixed_rules() -> list[Column]:
    """Opening-range break, VWAP bounce, EMA pullback, support bounce; in priority order."""
    close, atr = c("close"), c("atr")
    rng = c("high") - c("low")
    return [
        _signal((c("bar_no") > 30) & (c("pc") <= c("orh_30")) & (close > c("orh_30")) & (c("volume") > 1.5 * c("avg_vol")),
                "ORB", close, c("orl_30"), close + 2 * (close - c("orl_30")), F.lit(75)),
        _signal((c("pos") >= 20) & (F.abs(close - c("session_vwap")) < 0.2 * atr) & (c("low") <= c("session_vwap"))
                & (close > c("session_vwap")) & (c("rsi") > 40) & (c("rsi") < 60),
                "VWAP_Bounce", close, c("session_vwap") - 0.5 * atr, close + 1.5 * atr, F.lit(80)),
        _signal((c("pos") >= 20) & (c("ema_9") > c("ema_20")) & (c("ema_20") > c("session_vwap")) & (c("p_low") <= c("ema_20"))
                & (close > c("ema_9")) & (c("volume") > 1.3 * c("avg_vol")),
                "EMA_Pullback", close, c("ema_20") - 0.3 * atr, close + 1.5 * atr, F.lit(82)),
        _signal((c("pos") >= 10) & (c("low") <= c("low_10") * 1.001) & (close > c("low") + 0.6 * rng) & (c("rsi") < 40),
                "Support_Bounce", close, c("low_10") - 0.2 * atr, close + 2 * atr, F.lit(78)),
    ]


def flexible_confidence(kind: str) -> Column:
    """50 plus volume, trend, hour and regime bonuses, at most 95."""
    ratio, h = div(c("volume"), c("avg_vol")), hour_of_day(c("ts"))
    score = F.lit(50) + pick((ratio > 2, 15), (ratio > 1.5, 10), (ratio > 1.2, 5), default=0) \
        + pick((c("ema_9") > c("ema_21"), 5), default=0)
    if kind == "breakout":
        score = score + pick(((h >= 10) & (h <= 11), 10), default=0)
    if kind == "momentum":
        score = score + pick(((h >= 14) & (h <= 15), 10), default=0)
    if kind in ("breakout", "momentum"):
        score = score + pick((c("regime") == "trending", 10), default=0)
    if kind == "mean_reversion":
        score = score + pick((c("regime") == "ranging", 10), default=0)
    return F.least(score, F.lit(95))


def skip(kind: str) -> Column:
    """Reversals wait for 9:45; mean reversion stops at 15:30."""
    h = hour_of_day(c("ts"))
    if kind == "reversal":
        return h < 9.75
    if kind == "mean_reversion":
        return h >= 15.5
    return F.lit(False)


def flexible_rules() -> list[Column]:
    """The same four ideas with parameters chosen by regime and clock."""
    close, atr, h = c("close"), c("atr"), hour_of_day(c("ts"))
    vol, quiet, trending = c("regime") == "volatile", c("regime") == "quiet", c("regime") == "trending"
    n = pick((vol, 45), (quiet, 20), default=30)
    orh = pick((vol, c("orh_45")), (quiet, c("orh_20")), default=c("orh_30"))
    orl = pick((vol, c("orl_45")), (quiet, c("orl_20")), default=c("orl_30"))
    base = pick((vol, 1.3), (quiet, 2.0), default=1.5)
    width = pick((vol, 0.008), (quiet, 0.003), default=0.005)
    stop_dist = F.greatest(orh - orl, 0.5 * atr)
    orb = (c("bar_no") > n) & (div(orh - orl, orl) >= width) & (c("pc") <= orh) \
        & (close > orh + I.breakout_buffer(atr, orh, 0.0003, 0.1)) \
        & (c("volume") > c("avg_vol") * I.time_adjusted_volume_mult(c("ts"), base))
    near = pick((vol, 0.3), default=0.2) * atr
    lo_rsi, hi_rsi = pick((vol, 35), default=40), pick((vol, 65), default=60)
    bounce = (c("pos") >= 20) & (F.abs(close - c("session_vwap")) < near) & (c("low") <= c("session_vwap")) \
        & (close > c("session_vwap")) & (c("rsi") > lo_rsi) & (c("rsi") < hi_rsi)
    reach = 1.5 * atr * pick((h > 14.5, 0.7), default=1.0)
    deep = pick((trending, 0.7), default=0.5) * atr
    pull = (c("pos") >= 20) & (c("ema_9") > c("ema_21")) & (c("ema_21") > c("session_vwap")) & (c("p_low") <= c("ema_21")) \
        & (close > c("ema_9")) & (c("ema_21") - c("p_low") <= deep) \
        & (c("volume") > c("avg_vol") * I.time_adjusted_volume_mult(c("ts"), pick((trending, 1.2), default=1.3)))
    floor_ = pick((vol, c("low_15")), default=c("low_10"))
    tol = pick((vol, 0.3), default=0.2) * atr
    support = (c("pos") >= 10) & (F.abs(c("low") - floor_) < tol) & (div(close - c("low"), c("high") - c("low")) > 0.6) \
        & (c("rsi") < pick((vol, 35), default=40))
    return [
        _signal(orb & ~skip("breakout"), "ORB_Flexible", close, close - stop_dist, close + 2 * stop_dist, flexible_confidence("breakout")),
        _signal(bounce & ~skip("mean_reversion"), "VWAP_Bounce_Flexible", close, c("session_vwap") - 0.5 * atr, close + reach,
                flexible_confidence("mean_reversion")),
        _signal(pull & ~skip("momentum"), "EMA_Pullback_Flexible", close, c("ema_21") - 0.3 * atr, close + 1.5 * atr,
                flexible_confidence("momentum")),
        _signal(support & ~skip("reversal"), "Support_Bounce_Flexible", close, floor_ - 0.2 * atr, close + 2 * atr,
                flexible_confidence("reversal")),
    ]


def signals(df: DataFrame, rules: list[Column]) -> DataFrame:
    """All signals of all bars."""
    return df.select("ticker", "ts", "date", "regime", "last_of_session",
                     F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("_s")) \
        .select("ticker", "ts", "date", "regime", "last_of_session", "_s.*")


def first_match(df: DataFrame, rules: list[Column], least: float = 78.0) -> DataFrame:
    """On the last bar of each session, the first rule in priority order with enough confidence."""
    hit = F.try_element_at(F.filter(F.array(*rules), lambda x: x.isNotNull() & (x["confidence"] >= least)), F.lit(1))
    return df.filter("last_of_session").withColumn("_s", hit).filter(c("_s").isNotNull()).select("ticker", "ts", "date", "_s.*")


def once_per_day(sig: DataFrame) -> DataFrame:
    """Earliest signal of each (ticker, strategy, date); min_by combines map-side."""
    rest = [x for x in sig.columns if x not in ("ticker", "strategy", "date")]
    return sig.groupBy("ticker", "strategy", "date").agg(F.min_by(F.struct(*rest), "ts").alias("_x")).select(
        "ticker", "strategy", "date", "_x.*")
