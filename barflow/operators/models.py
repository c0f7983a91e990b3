"""Reversion models with trade limits, training statistics, forecast rows and blends."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barflow.functions.scalar import div, flag, pick
from barflow.operators import frames, indicators as I, series as S
from barflow.operators.salting import salted_join
from barflow.operators.scanners import limit_per_period

c = F.col


def patient_reversion(bars: DataFrame, interval_s: int = 900, hours=(14, 15, 20)) -> DataFrame:
    """Three ideas in order - far from SMA20, volume spike after a large move, tight-band fade; one signal a day."""
    df = I.add_change(S.blocked(bars, interval_s))
    df = I.add_trend_align(I.add_bollinger(I.add_rsi_wilder(df, 14), 20, 2.0, 0))
    df = df.withColumn("volatility", S.std(c("ret"), 20))
    df = I.add_percent_rank(df, "volatility", 100, "vol_pct")
    df = df.withColumns({"volume_ratio": div(c("volume"), S.mean(c("volume"), 20)), "p_ret": S.lag("ret"), "vol_ma": S.mean(c("volatility"), 50)})
    d, rsi, t = c("dist_sma20"), c("rsi"), c("trend_align")
    best = F.hour("ts").isin(*hours)
    far = F.abs(d) > 0.02
    one = pick((~((c("vol_pct") < 0.7) & best), 0), ((d > 0.02) & (rsi > 65) & (t <= 0), -1), ((d < -0.02) & (rsi < 35) & (t >= 0), 1), default=0)
    spike = c("volume_ratio") > 1.5
    two = pick((~(F.abs(c("p_ret")) > 0.005), 0), ((c("close") > c("bb_up")) & (rsi > 70), -1), ((c("close") < c("bb_lo")) & (rsi < 30), 1), default=0)
    three = pick((c("close") > c("bb_up"), -1), (c("close") < c("bb_lo"), 1), default=0)
    raw = pick((far, one), (spike, two), (c("bb_width") < 0.01, three), default=0)
    conf = pick((far, F.least(F.abs(d) * 50, F.lit(1.0))), (spike, 0.7), default=0.5)
    ready = (c(S.POS) >= 100) & d.isNotNull() & rsi.isNotNull() & c("vol_pct").isNotNull()
    calm = ~F.coalesce(c("volatility") > c("vol_ma") * 1.5, F.lit(False))
    df = df.withColumn("signal", F.when(ready & calm, F.coalesce(raw, F.lit(0))).otherwise(0))
    df = df.withColumn("confidence", F.when(c("signal") != 0, conf).otherwise(0.0))
    return limit_per_period(S.unblock(df), "signal", 1, [F.to_date("ts")])


def extreme_reversion(bars: DataFrame, interval_s: int = 900, per_day: int = 1, per_week: int = 3, far: float = 0.02,
                      spread_max: float = 0.003) -> DataFrame:
    """Four of five conditions far from the mean, three-sigma touch, wide-range fade; confidence of at least 0.7;
    at most ``per_day`` a day and ``per_week`` an ISO week."""
    df = I.add_change(S.blocked(bars, interval_s))
    df, w14 = df.withColumn("_tp", I.typical()), S.wilder(14)
    edges2, edges3 = (I.bands(c("sma20"), c("_sd"), k, x)[0] for k, x in ((2.0, "b2"), (3.0, "b3")))
    df = frames.add(
        df.drop("pc", "tr", "open"),
        {"_up": ("ewm", I.gain(), w14), "_dn": ("ewm", I.loss(), w14), "sma20": ("mean", "close", 20), "_sd": ("std_pop", "close", 20), "sma50": ("mean", "close", 50), "volatility": ("std", "ret", 20),
         "_v50": ("mean", "volume", 50), "support": ("min", "low", 20), "resistance": ("max", "high", 20), "_tp_mean": ("mean", "_tp", 20),
         "_tp_mad": ("mad", "_tp", 20), "p_close_pos": ("lag", I.range_places()["close_pos"], 1)},
        {"rsi": I.rsi_of(c("_up"), c("_dn")), "volume_ratio": div(c("volume"), c("_v50")), "cci": div(c("_tp") - c("_tp_mean"), 0.015 * c("_tp_mad")), **edges2, **edges3, **I.range_places(),
         "d20": div(c("close") - c("sma20"), c("sma20")), "d50": div(c("close") - c("sma50"), c("sma50"))},
        ["high", "low", "_up", "_dn", "_tp", "_tp_mean", "_tp_mad", "_v50", "_sd", "d", "ret", "sma50", "sma20", "support", "resistance", "b2_z", "b3_z", "volume"],
        {"vol_rank": ("rank", "volatility", 100), "_rv": ("some_max", "volatility", 5, 1), "_av": ("some_mean", "volatility", 45, 6)})
    d, rsi, rp, vr = c("d20"), c("rsi"), c("range_pos"), c("volume_ratio")

    def total(*conds):      # a lambda keeps the projection out of whole-stage code, where it is a method too large for the JVM to compile
        return F.size(F.filter(F.array(*conds), lambda x: x))
    over = total(rsi > 70, c("cci") > 100, c("close") > c("b2_up"), rp > 0.9, c("spread") < spread_max)
    under = total(rsi < 30, c("cci") < -100, c("close") < c("b2_lo"), rp < 0.1, c("spread") < spread_max)
    aligned = ((d > 0) & (c("d50") > 0)) | ((d < 0) & (c("d50") < 0))
    one = pick((~F.coalesce(aligned, F.lit(False)), 0), ((d > far) & (over >= 4), -1), ((d < -far) & (under >= 4), 1), default=0)
    conf1 = F.least(F.abs(d) * 40 + F.when(d > 0, over).otherwise(under) * 0.1, F.lit(1.0))
    touch = (c("close") > c("b3_up")) | (c("close") < c("b3_lo"))
    two = pick((~(c("vol_rank") > 0.5), 0), ((c("close") > c("b3_up")) & (rsi > 75) & (vr < 1.5), -1),
               ((c("close") < c("b3_lo")) & (rsi < 25) & (vr < 1.5), 1), default=0)
    three = pick(((rp > 0.95) & (c("p_close_pos") < 0.9) & (vr > 1.5) & (rsi > 65), -1),
                 ((rp < 0.05) & (c("p_close_pos") > 0.1) & (vr > 1.5) & (rsi < 35), 1), default=0)
    raw = pick((F.abs(d) > far, one), (touch, two), (c("range_rel") > 0.03, three), default=0)
    conf = pick((F.abs(d) > far, conf1), (touch, 0.8), default=0.6)
    ready = (c(S.POS) >= 100) & d.isNotNull() & rsi.isNotNull() & c("cci").isNotNull()
    calm = ~F.coalesce(c("_rv") > c("_av") * 2, F.lit(False))
    df = df.withColumn("confidence", F.when(ready & (raw != 0), conf).otherwise(0.0))
    df = df.withColumn("signal", F.when(ready & calm & (c("confidence") >= 0.7), F.coalesce(raw, F.lit(0))).otherwise(0))
    df = limit_per_period(S.unblock(df), "signal", per_day, [F.to_date("ts")])
    return limit_per_period(df, "signal", per_week, [iso_week("ts")])


def iso_week(ts: str) -> Column:
    """Monday of the ISO week: year and week in one key."""
    return F.date_trunc("week", ts)


def reversion_stats(bars: DataFrame, interval_s: int = S.DAY, ahead: int = 4, thresholds=(0.01, 0.015, 0.02, 0.025)) -> DataFrame:
    """For each ticker and distance above SMA20: cases, mean return after ``ahead`` bars and share of falls."""
    df = I.add_trend_align(S.blocked(bars, interval_s)).withColumn("fut", div(S.lead("close", ahead), c("close")) - 1)
    df = S.unblock(df).filter(c("fut").isNotNull()).select("ticker", "dist_sma20", "fut",
                                                            F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    df = df.filter(c("dist_sma20") > c("threshold"))
    return df.groupBy("ticker", "threshold").agg(F.count(F.lit(1)).alias("cases"), F.avg("fut").alias("avg_return"),
                                                 F.avg(flag(c("fut") < 0)).alias("win_rate"))


def extreme_stats(bars: DataFrame, interval_s: int = S.DAY, far: float = 0.015, profit: float = 0.002) -> DataFrame:
    df = I.add_trend_align(S.blocked(bars, interval_s)).withColumn("fut", div(S.lead("close", 4), c("close")) - 1)
    df = S.unblock(df.filter(c(S.POS) >= 100)).filter(c("fut").isNotNull() & (F.abs("dist_sma20") > far))
    return df.groupBy("ticker").agg(F.count(F.lit(1)).alias("samples"), F.avg(flag(F.abs("fut") > profit)).alias("profitable"))


def latest_signals(signals: DataFrame, n: int = 5, share: float = 0.8) -> DataFrame:
    """The last n non-zero signals in the final 1 - share of each ticker's rows (needs _pos of a blocked frame)."""
    total = signals.groupBy("ticker").agg(F.count_if(~c(S.HALO)).alias("_total"))
    df = _with_position(salted_join(signals, total, ["ticker"], ["ts"])).filter((c("pos") >= F.floor(c("_total") * share)) & (c("signal") != 0))
    w = Window.partitionBy("ticker").orderBy(c("ts").desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(c("_rn") <= n).drop("_rn", "_total", "pos")


def _with_position(df: DataFrame) -> DataFrame:
    return S.unblock(df.withColumn("pos", c(S.POS)))


def volatility_forecast(bars: DataFrame, interval_s: int = 900, train: int = 40, recent: int = 20) -> DataFrame:
    """Latest row per ticker: recent mean return, volatility of the bars before, confidence 0.8 * their ratio."""
    df = I.add_change(S.blocked(bars, interval_s))
    df = df.withColumns({"training_vol": F.stddev_samp("ret").over(S.w(train - 1, recent)), "momentum": F.avg("ret").over(S.w(recent - 1)),
                         "current_vol": F.stddev_samp("ret").over(S.w(recent - 1)),
                         "_ok": c(S.POS) >= train + recent - 1})
    df = S.unblock(df.filter("_ok"))
    last = df.groupBy("ticker").agg(F.max_by(F.struct("ts", "close", "training_vol", "momentum", "current_vol"), "ts").alias("x")).select("ticker", "x.*")
    return last.withColumn("confidence", 0.8 * div(F.least("training_vol", "current_vol"), F.greatest("training_vol", "current_vol")))


def momentum_bias(bars: DataFrame, interval_s: int = 900, mult: float = 1.0) -> DataFrame:
    """(SMA8 - SMA32) / SMA32 of the latest bar, scaled 1, 1.5 and 2 for the three horizons, in percent."""
    df = S.blocked(bars, interval_s)
    df = df.withColumns({"_a": S.mean(c("close"), 8), "_b": S.mean(c("close"), 32)})
    df = S.unblock(df.withColumn("bias", div(c("_a") - c("_b"), c("_b"))))
    last = df.groupBy("ticker").agg(F.max_by(F.struct("ts", "close", "bias"), "ts").alias("x")).select("ticker", "x.*")
    return last.withColumns({h: c("bias") * k * 100 * mult for h, k in (("h1", 1.0), ("h3", 1.5), ("eod", 2.0))})


def blend(a: DataFrame, b: DataFrame, horizons=("h1", "h3", "eod")) -> DataFrame:
    """Confidence-weighted blend of two forecasts (0.7 / 0.3 without confidence); a missing side gives way."""
    x = a.select("ticker", c("confidence").alias("_ca"), *[c(h).alias(f"_a_{h}") for h in horizons])
    y = b.select("ticker", c("confidence").alias("_cb"), *[c(h).alias(f"_b_{h}") for h in horizons])
    j = x.join(y, "ticker", "full_outer")
    total = c("_ca") + c("_cb")
    wa = F.when(total == 0, 0.7).otherwise(div(c("_ca"), total))
    return j.select("ticker", *[F.coalesce(wa * c(f"_a_{h}") + (1 - wa) * c(f"_b_{h}"), c(f"_b_{h}"), c(f"_a_{h}")).alias(h) for h in horizons],
                    F.coalesce("_ca", "_cb").alias("confidence"))


def forecast_rows(df: DataFrame, threshold: float, horizons=("h1", "h3", "eod")) -> DataFrame:
    """Wide forecast (percent per horizon, price) -> one row per horizon with price, direction and strength label."""
    top = F.greatest(*[F.abs(c(h)) for h in horizons])
    conf = pick((top > 0.5, "HIGH"), (top > 0.2, "MEDIUM"), default="LOW")
    rows = F.array(*[F.struct(F.lit(h).alias("horizon"), c(h).alias("pct")) for h in horizons])
    df = df.select("ticker", "ts", "close", conf.alias("confidence"), F.explode(rows).alias("_r")).select("ticker", "ts", "close", "confidence", "_r.*")
    return df.withColumns({"price": c("close") * (1 + c("pct") / 100),
                           "direction": pick((c("pct") > threshold, "BULLISH"), (c("pct") < -threshold, "BEARISH"), default="NEUTRAL")})


def horizon_vote(rows: DataFrame) -> DataFrame:
    """Majority of horizons, mean of the confidences above 0.6 (0.3 without any)."""
    g = rows.groupBy("ticker").agg(F.count_if(c("direction") == "BULLISH").alias("bullish"), F.count_if(c("direction") == "BEARISH").alias("bearish"),
                                   F.coalesce(F.avg(F.when(c("score") > 0.6, c("score"))), F.lit(0.3)).alias("overall_confidence"))
    return g.withColumn("recommendation", pick((c("bullish") > c("bearish"), "BUY"), (c("bearish") > c("bullish"), "SELL"), default="HOLD"))
