"""Multi-timeframe alert rules: a trigger on the slow bars and a cue on the fast bars, all rules in one pass."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barflow.functions.scalar import div, flag, pick
from barflow.operators import candles as K, frames, indicators as I, series as S

c = F.col

SLOW = ["open", "high", "low", "close", "pc", "ema_20", "ema_50", "p_ema_20", "p_ema_50", "sma_50", "sma_200", "rsi_14", "nr7",
        "inside_bar", "bb_pos", "bb_lo", "bb_mid", "high_52w", "volume_spike", "gap_pct", "atr_14", "hammer", "engulfing",
        "range_5", "range_20", "bars"]
FAST = ["high", "close", "volume", "p_high", "p_volume", "ema_24", "rsi_14", "volume_spike", "hammer", "engulfing", "inside_bar",
        "obv_delta", "obv_slope", "price_slope", "obv_slope3", "bars"]


_BEFORE = {f"_p_{x}": ("lag", x, 1) for x in ("open", "high", "low")}


def _flags() -> dict[str, Column]:
    return K.reversal_flags(c("_p_open"), c("_p_high"), c("_p_low"), c("pc"))


def slow_features(bars: DataFrame, interval_s: int = S.DAY) -> DataFrame:
    """What the rules read of the slow bars: values of ``indicators.daily_bundle`` in one pass over the sorted rows."""
    w14 = S.wilder(14)
    df = I.add_change(S.blocked(bars, interval_s)).withColumn("bar_range", c("high") - c("low"))
    up, lo = c("bb_mid") + 2 * c("_sd"), c("bb_mid") - 2 * c("_sd")
    df = frames.add(
        df.drop("ret"),
        {**_BEFORE, **{f"ema_{n}": ("ewm", "close", S.span(n)) for n in (20, 50)}, **{f"p_ema_{n}": ("ewm", "close", S.span(n), 1) for n in (20, 50)},
         "_up": ("ewm", I.gain(), w14), "_dn": ("ewm", I.loss(), w14), "atr_14": ("ewm", "tr", w14), "sma_50": ("some_mean", "close", 50), "sma_200": ("some_mean", "close", 200),
         "_v20": ("some_mean", "volume", 20), "bb_mid": ("mean", "close", 20), "_sd": ("std_pop", "close", 20), "high_52w": ("some_max", "high", 252),
         "_nr7": ("min", "bar_range", 7), "range_5": ("some_mean", "bar_range", 5), "range_20": ("some_mean", "bar_range", 20)},
        {"rsi_14": I.rsi_of(c("_up"), c("_dn")), "bb_lo": lo, "bb_pos": div(c("close") - lo, up - lo), "nr7": flag(c("bar_range") == c("_nr7")),
         "volume_spike": div(c("volume"), c("_v20")), "gap_pct": F.coalesce(div(c("open") - c("pc"), c("pc")) * 100, F.lit(0.0)), **_flags(), "bars": c(S.POS) + 1})
    return S.unblock(df).select("ticker", "ts", *SLOW)


def fast_features(bars: DataFrame, interval_s: int = 3600) -> DataFrame:
    """What the rules read of the fast bars, in one pass over the sorted rows. The rules look at changes of OBV only, and these are sums of its last steps: the
    level, which needs the totals of all blocks before, is not asked for."""
    w14 = S.wilder(14)
    df = I.add_change(S.blocked(bars, interval_s)).withColumn("_s0", F.coalesce(F.signum(c("d")), F.lit(0.0)) * c("volume"))
    price = (-4 * c("_c4") + -2 * c("_c3") + 2 * c("pc") + 4 * c("close")) / 20
    df = frames.add(
        df.drop("ret", "tr"),
        {**_BEFORE, "p_volume": ("lag", "volume", 1), "ema_24": ("ewm", "close", S.span(24)), "_up": ("ewm", I.gain(), w14), "_dn": ("ewm", I.loss(), w14),
         "_v24": ("some_mean", "volume", 24), **{f"_s{k}": ("lag", "_s0", k) for k in (1, 2, 3)}, **{f"_c{k}": ("lag", "close", k) for k in (3, 4)}},
        {"p_high": c("_p_high"), "rsi_14": I.rsi_of(c("_up"), c("_dn")), "volume_spike": div(c("volume"), c("_v24")), "price_slope": price,
         "obv_delta": F.when(c(S.POS) >= 1, c("_s0")), "obv_slope3": F.when(c(S.POS) >= 2, (c("_s0") + c("_s1")) / 2),
         "obv_slope": F.when(c(S.POS) >= 4, (4 * c("_s0") + 6 * c("_s1") + 6 * c("_s2") + 4 * c("_s3")) / 20), **_flags(), "bars": c(S.POS) + 1})
    return S.unblock(df).select("ticker", "ts", *FAST)


def pair_latest(slow: DataFrame, fast: DataFrame) -> DataFrame:
    """Latest slow row next to the latest fast row of each ticker (both sides combine map-side)."""
    a = slow.groupBy("ticker").agg(F.max_by(F.struct("ts", *SLOW), "ts").alias("s"))
    b = fast.groupBy("ticker").agg(F.max_by(F.struct("ts", *FAST), "ts").alias("f"))
    return a.join(b, "ticker", "left")


def pair_history(slow: DataFrame, fast: DataFrame, unit: str) -> DataFrame:
    """Every slow row next to the last fast row inside it; an equi-join on (ticker, period)."""
    a = slow.select("ticker", c("ts").alias("period"), F.struct("ts", *SLOW).alias("s"))
    period = F.date_trunc(unit, "ts").cast(slow.schema["ts"].dataType)
    b = fast.groupBy("ticker", period.alias("period")).agg(F.max_by(F.struct("ts", *FAST), "ts").alias("f"))
    return a.join(b, ["ticker", "period"], "left")


# Rule, action, risk level.
RULES = {
    "Golden Cross": ("BUY", "LOW"), "20-EMA Bounce": ("BUY", "LOW"), "NR7 + Inside Bar Breakout": ("BUY on breakout", "LOW"),
    "52-Week High Breakout": ("BUY", "MEDIUM"), "Gap-and-Go": ("BUY", "MEDIUM"), "BB Pierce Reversal": ("BUY", "MEDIUM"),
    "Over-extension Fade": ("SHORT/SELL", "HIGH"), "Hammer at SMA50": ("BUY", "LOW"), "Hammer at SMA200": ("BUY", "LOW"),
    "Bullish Engulfing Reversal": ("BUY", "MEDIUM"),
}


def rule_conditions(oversold: float = 30.0) -> dict[str, Column]:
    def s(x):
        return c(f"s.{x}")

    def f(x):
        return c(f"f.{x}")
    has_fast = c("f").isNotNull()
    trend = (s("bars") >= 50) & (f("bars") >= 24)
    year = s("bars") >= 252
    reversal_candle = (s("hammer") != 0) | (s("engulfing") != 0)
    extension = div(s("close") - s("ema_20"), s("atr_14"))
    at50 = F.abs(s("low") - s("sma_50")) / s("sma_50") < 0.01
    at200 = F.abs(s("low") - s("sma_200")) / s("sma_200") < 0.01
    hammer = (s("bars") >= 200) & (s("hammer") != 0) & (f("inside_bar") != 0) & (f("close") > s("high"))
    conds = {
        "Golden Cross": trend & (s("ema_20") > s("ema_50")) & (s("p_ema_20") <= s("p_ema_50")) & (s("close") >= s("sma_50"))
        & (s("rsi_14") > 55) & (f("close") > f("ema_24")) & (f("volume_spike") >= 1.2),
        "20-EMA Bounce": trend & (s("close") > s("ema_20")) & (s("ema_20") > s("ema_50")) & (s("low") <= s("ema_20"))
        & (s("close") > s("open")) & ((f("hammer") != 0) | (f("engulfing") != 0)) & (f("obv_delta") > 0),
        "NR7 + Inside Bar Breakout": year & (s("nr7") != 0) & (s("inside_bar") != 0) & (s("bb_pos") < 0.2) & (f("volume_spike") >= 1.5),
        "52-Week High Breakout": year & (s("close") >= s("high_52w")) & (s("volume_spike") >= 1.5) & (f("close") > s("close")),
        "Gap-and-Go": year & (s("gap_pct") > 2) & (s("close") > s("open")) & (s("rsi_14") > 60)
        & (f("close") > (s("open") + s("pc")) / 2),
        "BB Pierce Reversal": (s("bars") >= 20) & (s("close") < s("bb_lo")) & (s("rsi_14") <= oversold) & reversal_candle
        & ((f("engulfing") != 0) | (f("rsi_14") > 40)),
        "Over-extension Fade": (s("bars") >= 20) & (s("atr_14") > 0) & (extension >= 2) & (s("rsi_14") > 75) & (f("bars") > 1)
        & (f("high") < f("p_high")) & (f("engulfing") != 0) & (f("volume") < f("p_volume")),
        "Hammer at SMA50": hammer & at50,
        "Hammer at SMA200": hammer & ~at50 & at200,
        "Bullish Engulfing Reversal": (s("bars") >= 200) & (s("engulfing") != 0) & (s("range_5") < 0.7 * s("range_20"))
        & (f("bars") > 5) & (f("obv_slope") > 0) & (f("price_slope") < 0) & (s("close") > s("open")),
    }
    return {k: has_fast & v for k, v in conds.items()}


def alerts(pairs: DataFrame) -> DataFrame:
    """All raised rules with volume confirmation: HIGH when the fast spike is at least 1.3 and OBV moves with the
    action, MEDIUM otherwise."""
    conds = rule_conditions()
    items = F.array(*[
        F.when(cond, F.struct(F.lit(name).alias("pattern"), F.lit(RULES[name][0]).alias("action"),
                              F.lit(RULES[name][1]).alias("risk_level"),
                              (c("s.bb_mid") if name == "BB Pierce Reversal" else F.lit(None).cast("double")).alias("target")))
        for name, cond in conds.items()])
    df = pairs.withColumn("_a", F.explode(F.filter(items, lambda x: x.isNotNull())))
    buy = c("_a.action").startswith("BUY")
    obv_ok = (c("f.bars") <= 2) | (buy & (c("f.obv_slope3") > 0)) | (~buy & (c("f.obv_slope3") < 0))
    ok = F.coalesce((c("f.volume_spike") >= 1.3) & obv_ok, F.lit(False))
    return df.select("ticker", c("s.ts").alias("ts"), "_a.pattern", "_a.action", "_a.risk_level", "_a.target",
                     F.when(ok, 1).otherwise(0).alias("volume_confirmed"),
                     pick((ok, "HIGH"), default="MEDIUM").alias("confidence"))
