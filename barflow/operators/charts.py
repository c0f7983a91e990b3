"""Chart patterns, trade levels and volume confirmation.

Peaks and troughs: a bar strictly above (below) both neighbours and not exceeded within two bars on either side.  This
rule does not depend on the order in which peaks are visited, so plateaus give no peak."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barflow.functions.scalar import clamp, div, flag, pick
from barflow.operators import indicators as I, series as S

c = F.col


def session_extrema(bars: DataFrame) -> DataFrame:
    """Peak and trough flags within each (ticker, date), with prominence: the drop from the peak to the higher of the
    session's minima before and after it.  A session is bounded by the clock."""
    key = Window.partitionBy("ticker", "date")
    ws = key.orderBy("ts")
    back = key.orderBy(c("ts").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run, near = ws.rowsBetween(Window.unboundedPreceding, 0), ws.rowsBetween(-2, 2)
    df = bars.withColumn("date", F.to_date("ts"))
    df = df.withColumns({
        "no": (F.row_number().over(ws) - 1).cast("int"),
        "peak": flag((c("high") > F.lag("high").over(ws)) & (c("high") > F.lead("high").over(ws)) & (c("high") == F.max("high").over(near))),
        "trough": flag((c("low") < F.lag("low").over(ws)) & (c("low") < F.lead("low").over(ws)) & (c("low") == F.min("low").over(near))),
        "_h0": F.min("high").over(run), "_l0": F.max("low").over(run)})
    df = df.withColumns({"_h1": F.min("high").over(back), "_l1": F.max("low").over(back)})
    return df.withColumns({"peak_prom": c("high") - F.greatest("_h0", "_h1"),
                           "trough_prom": F.least("_l0", "_l1") - c("low")}).drop("_h0", "_h1", "_l0", "_l1")


def _session_arrays(ex: DataFrame) -> DataFrame:
    """One row per session with its bars, peaks and troughs as short sorted arrays."""
    up = F.struct(c("no").alias("i"), c("high").alias("v"), c("peak_prom").alias("p"))
    dn = F.struct(c("no").alias("i"), c("low").alias("v"), c("trough_prom").alias("p"))
    return ex.groupBy("ticker", "date").agg(
        F.array_sort(F.collect_list(F.when(c("peak") == 1, up))).alias("peaks"),
        F.array_sort(F.collect_list(F.when(c("trough") == 1, dn))).alias("troughs"),
        F.array_sort(F.collect_list(F.struct(c("no").alias("i"), c("volume").alias("v")))).alias("vols"),
        F.max_by("close", "ts").alias("current_price"), F.count(F.lit(1)).alias("bars"))


def _best(arr: Column, keep, high: bool, late: bool) -> Column:
    """Highest (lowest) point of arr that passes keep; ties go to the later or earlier one."""
    s = F.transform(F.filter(arr, keep), lambda x: F.struct((x["v"] if high else -x["v"]).alias("k"),
                                                            (x["i"] if late else -x["i"]).alias("t"), x["i"].alias("i"), x["v"].alias("v")))
    return F.array_max(s)


def head_and_shoulders(ex: DataFrame, inverse: bool = False) -> DataFrame:
    """First middle peak with a lower best peak on both sides and a trough between each pair."""
    df = _session_arrays(ex)
    tops, bots = ("troughs", "peaks") if inverse else ("peaks", "troughs")
    sign = -1 if inverse else 1
    df = df.withColumns({"_t": F.transform(tops, lambda x: F.struct(x["i"].alias("i"), (x["v"] * sign).alias("v"))),
                         "_b": F.transform(bots, lambda x: F.struct(x["i"].alias("i"), (x["v"] * sign).alias("v")))})

    def shoulders(p):
        left = _best(c("_t"), lambda x: (x["i"] < p["i"]) & (x["v"] < p["v"]), True, True)
        right = _best(c("_t"), lambda x: (x["i"] > p["i"]) & (x["v"] < p["v"]), True, False)
        return F.struct(p["i"].alias("p"), p["v"].alias("pv"), left.alias("l"), right.alias("r"))

    def necks(s):
        lt = _best(c("_b"), lambda x: (x["i"] > s["l"]["i"]) & (x["i"] < s["p"]), False, False)
        rt = _best(c("_b"), lambda x: (x["i"] > s["p"]) & (x["i"] < s["r"]["i"]), False, False)
        return F.struct(s["p"].alias("p"), s["pv"].alias("pv"), s["l"].alias("l"), s["r"].alias("r"), lt.alias("lt"), rt.alias("rt"))

    found = F.filter(F.transform(F.transform("_t", shoulders), necks),
                     lambda s: s["l"].isNotNull() & s["r"].isNotNull() & s["lt"].isNotNull() & s["rt"].isNotNull())
    df = df.withColumn("_s", F.try_element_at(found, F.lit(1))).filter(c("_s").isNotNull())
    return df.select(
        "ticker", "date", F.lit(("Inverse " if inverse else "") + "Head and Shoulders").alias("pattern"),
        F.array(*[c(f"_s.{x}") for x in ("l.i", "lt.i", "p", "rt.i", "r.i")]).alias("points"), (c("_s.pv") * sign).alias("head"),
        (c("_s.r.v") * sign).alias("right"), ((c("_s.lt.v") + c("_s.rt.v")) / 2 * sign).alias("neckline"), F.lit(None).cast("double").alias("twin"),
        "current_price", "bars", "vols")


def double_extreme(ex: DataFrame, bottom: bool = False, near: float = 0.05, prominence: float = 0.1) -> DataFrame:
    """First pair of consecutive prominent peaks within ``near`` of their mean, with the lowest trough between."""
    df = _session_arrays(ex)
    tops, bots = ("troughs", "peaks") if bottom else ("peaks", "troughs")
    df = df.withColumn("_t", F.filter(tops, lambda x: x["p"] >= prominence))
    nxt = F.concat(F.slice("_t", F.lit(2), F.size("_t")), F.array(F.lit(None).cast(df.schema["_t"].dataType.elementType)))

    def pair(a, b):
        mid = _best(c(bots), lambda x: (x["i"] > a["i"]) & (x["i"] < b["i"]), bottom, False)
        close_by = F.abs(a["v"] - b["v"]) < near * (a["v"] + b["v"]) / 2
        return F.when(close_by & mid.isNotNull(), F.struct(a.alias("a"), b.alias("b"), mid.alias("m")))
    found = F.filter(F.zip_with("_t", nxt, pair), lambda s: s.isNotNull())
    df = df.filter(F.size("_t") >= 2).withColumn("_s", F.try_element_at(found, F.lit(1))).filter(c("_s").isNotNull())
    return df.select(
        "ticker", "date", F.lit("Double Bottom" if bottom else "Double Top").alias("pattern"),
        F.array(c("_s.a.i"), c("_s.m.i"), c("_s.b.i")).alias("points"), c("_s.a.v").alias("head"), c("_s.b.v").alias("right"),
        c("_s.m.v").alias("neckline"), c("_s.a.v").alias("twin"), "current_price", "bars", "vols")


def add_point_volume(p: DataFrame) -> DataFrame:
    """Volume checks at a pattern's own points (rows of ``head_and_shoulders`` or ``double_extreme``): at the left shoulder, head and right shoulder, or at both
    extremes, against the mean of the bars from the first point to the last. Adds hs_reliability or dt_reliability (shares of three) and ``no``,
    the bar of the last point."""
    first, last = c("points")[0], F.try_element_at("points", F.lit(-1))
    at = lambda i: F.try_element_at("vols", i + 1)["v"]  # noqa: E731  (the session's bars in order, counted from 0)
    inside = F.filter("vols", lambda x: (x["i"] >= first) & (x["i"] <= last))
    avg = F.aggregate(inside, F.lit(0.0), lambda a, x: a + x["v"]) / F.size(inside)
    double, head = c("twin").isNotNull(), c("points")[2]
    hs = flag(at(head) > avg * 1.2) + flag(at(last) < at(first) * 0.9) + flag(at(last) < avg)
    dt = flag(at(last) < at(first) * 0.85) + flag(at(first) > avg) + flag(at(last) < avg * 0.9)
    return p.withColumns({"hs_reliability": F.when(~double, hs / 3.0), "dt_reliability": F.when(double, dt / 3.0), "no": last})


def trade_levels(p: DataFrame) -> DataFrame:
    """Entry 1 % beyond the neckline, stop 1 % beyond the shoulder or twin level, target one height (0.8 for doubles)."""
    sell = c("pattern").isin("Head and Shoulders", "Double Top")
    double = c("twin").isNotNull()
    level = F.when(double, (c("head") + c("right")) / 2).otherwise(c("head"))
    height = F.abs(level - c("neckline")) * F.when(double, 0.8).otherwise(1.0)
    guard = F.when(double, level).otherwise(c("right"))
    df = p.withColumns({
        "action": pick((sell, "SELL"), default="BUY"),
        "entry": c("neckline") * F.when(sell, 0.99).otherwise(1.01),
        "stop_loss": guard * F.when(sell, 1.01).otherwise(0.99),
        "target": F.when(sell, c("neckline") - height).otherwise(c("neckline") + height)})
    df = df.withColumns({"risk_reward": F.coalesce(div(F.abs(c("target") - c("entry")), F.abs(c("entry") - c("stop_loss"))), F.lit(0.0)),
                         "distance_pct": div(F.abs(c("current_price") - c("entry")), c("current_price")) * 100})
    first, last = F.array_min("points"), F.array_max("points")

    def mean_of(arr):
        return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x["v"]) / F.size(arr)
    inside = mean_of(F.filter("vols", lambda x: (x["i"] >= first) & (x["i"] <= last)))
    recent = mean_of(F.filter("vols", lambda x: x["i"] >= c("bars") - 5))
    symmetry = 1 - F.abs(c("head") - c("right")) / ((c("head") + c("right")) / 2)
    score = F.when(double, 50 + symmetry * 30 + F.when(inside > recent * 1.2, 10).otherwise(0)
                   - F.when(c("bars") - last < 5, 10).otherwise(0)).otherwise(F.lit(50.0))
    return df.withColumn("confidence", clamp(score, 0.0, 100.0)).drop("vols")


# ---------------------------------------------------------------- indicator-based patterns

def add_potential_patterns(df: DataFrame) -> DataFrame:
    """Potential double top or bottom, ascending or descending triangle; first rule that holds, on a blocked frame."""
    df = I.add_rsi_sma(I.add_change(df), 14, "_rsi")
    df = df.withColumns({"_s20": S.mean(c("close"), 20), "_s50": S.mean(c("close"), 50), "_mx": F.max("close").over(S.w(5, 1)),
                         "_mn": F.min("close").over(S.w(5, 1))})
    x, s20, s50, rsi = c("close"), c("_s20"), c("_s50"), F.coalesce(c("_rsi"), F.lit(50.0))
    name = pick(((x > s20) & (rsi > 70) & (x > c("_mx") * 0.98), "Potential Double Top"),
                ((x < s20) & (rsi < 30) & (x < c("_mn") * 1.02), "Potential Double Bottom"),
                ((s20 > s50) & (rsi > 50) & (rsi < 70) & (x > s20), "Ascending Triangle Pattern"),
                ((s20 < s50) & (rsi < 50) & (rsi > 30) & (x < s20), "Descending Triangle Pattern"))
    return df.withColumn("chart_pattern", F.when(c(S.POS) >= 50, name)).drop("_rsi", "_s20", "_s50", "_mx", "_mn")


def add_volume_confirmation(df: DataFrame, mult: float) -> DataFrame:
    """0.9 / 0.7 / 0.5 / 0.3 by volume against the mean of the 20 bars before; 0.5 without history."""
    ratio = F.when(c(S.POS) >= 20, div(c("volume"), F.avg("volume").over(S.w(20, 1))))
    return df.withColumn("_vr", ratio).withColumn("volume_confirmation", pick(
        (c("_vr").isNull(), 0.5), (c("_vr") > 1.5 * mult, 0.9), (c("_vr") > 1.2 * mult, 0.7), (c("_vr") > 0.8 * mult, 0.5), default=0.3)).drop("_vr")


def entry_price() -> Column:
    """Next bar's open, or 0.1 % above the close on the newest bar."""
    return F.coalesce(S.lead("open"), c("close") * 1.001)


def add_volume_validation(df: DataFrame, n: int = 20) -> DataFrame:
    """Volume shape of the n+1 bars up to here: head-and-shoulders and double-top checks as shares of three."""
    df = df.withColumn("_v", F.collect_list("volume").over(S.w(n + 1)))
    size = F.size("_v")
    first, last = F.element_at("_v", F.lit(1)), F.element_at("_v", F.lit(-1))
    mid = F.element_at("_v", F.floor(size / 2).cast("int") + 1)
    avg = F.avg("volume").over(S.w(n + 1))
    hs = flag(mid > avg * 1.2) + flag(last < first * 0.9) + flag(last < avg)
    dt = flag(last < first * 0.85) + flag(first > avg) + flag(last < avg * 0.9)
    return df.withColumns({"hs_reliability": hs / 3.0, "dt_reliability": dt / 3.0}).drop("_v")


def add_context(df: DataFrame) -> DataFrame:
    """ATR, running VWAP and volatility threshold next to each bar (blocked with the VWAP carry)."""
    df = I.add_running_vwap(I.add_change(df))
    df = S.ewm(df, {"atr": (c("tr"), S.wilder(14), False)})
    pct = div(c("atr"), c("close")) * 100
    return df.withColumns({"vwap_deviation": div(c("close") - c("vwap_typical"), c("vwap_typical")) * 100,
                           "volatility_threshold": F.greatest(pct * 0.25, F.lit(0.1)), "atr_pct": pct})


def enhance_patterns(patterns: DataFrame, context: DataFrame, on: tuple[str, ...] = ("ticker", "ts")) -> DataFrame:
    """Equi-join on (ticker, ts), or ``on``; validated chart patterns gain ten times the reliability, others lose a fifth. Patterns may bring the reliabilities of
    their own points, which come before those of ``context``."""
    own = [x for x in ("hs_reliability", "dt_reliability") if x in patterns.columns]
    df = patterns.join(context.drop(*own), list(on))
    hs, dbl = c("pattern").contains("Head and Shoulder"), c("pattern").rlike("Double (Top|Bottom)")
    rel = pick((hs, c("hs_reliability")), (dbl, c("dt_reliability")))
    valid = F.coalesce((hs & (c("hs_reliability") > 0.6)) | (dbl & (c("dt_reliability") > 0.5)), F.lit(False))
    df = df.withColumns({"reliability": rel, "volume_validated": flag(valid)})
    return df.withColumn("adjusted_confidence", pick(
        (c("kind") != "chart", c("confidence")), (valid, F.least(c("confidence") + 10 * rel, F.lit(100.0))), default=c("confidence") * 0.8))


RARE = ["Three Black Crows", "Three White Soldiers", "Morning Star", "Evening Star"]


def quality_score() -> Column:
    """0-100: confidence 30, volume 25, VWAP side 20, volatility 15, rarity 10."""
    dev = c("vwap_deviation")
    s = c("adjusted_confidence") / 100 * 30
    s = s + pick((c("volume_validated") == 1, c("reliability") * 25), (c("kind") == "candlestick", 15.0), default=0.0)
    s = s + pick(((c("direction") == "bullish") & (dev < 0), F.least(F.abs(dev) * 4, F.lit(20.0))),
                 ((c("direction") == "bearish") & (dev > 0), F.least(dev * 4, F.lit(20.0))), default=0.0)
    s = s + pick((c("atr_pct") > 2, 15.0), (c("atr_pct") > 1, 10.0), default=5.0)
    s = s + pick((c("pattern").isin(*RARE), 10.0), (c("kind") == "chart", 7.0), default=3.0)
    return F.least(s, F.lit(100.0))


# ---------------------------------------------------------------- volume scores (blocked volume bundle)

def add_signal_strength(df: DataFrame, n: int = 20) -> DataFrame:
    """Volume score 0-1 for a bullish and a bearish outlook, from the last n bars: surge, trend, OBV, climax, agreement."""
    df = df.withColumns({"_r3": F.avg("volume_ratio").over(S.w(3)), "_rmax": F.max("volume_ratio").over(S.w(n)),
                         "_c0": F.first("close").over(S.w(n)), "_v5": F.avg("volume").over(S.w(5)),
                         "_v0": F.avg("volume").over(S.w(5, n - 5))})
    surge = pick((c("_r3") > 1.5, 0.8), (c("_r3") > 1.2, 0.6), default=0.4)
    vol_up, obv_up = c("volume_sma_5") > c("volume_sma_20"), c("obv") > c("obv_sma")
    climax = pick((c("_rmax") > 2.0, 0.9), (c("_rmax") < 0.5, 0.1), default=0.5)
    agree = pick(((c("close") > c("_c0")) == (c("_v5") > c("_v0")), 0.7), default=0.3)
    base = surge * 0.3 + climax * 0.2 + agree * 0.1
    bull = base + 0.2 * pick((vol_up, 0.7), default=0.3) + 0.2 * pick((obv_up, 0.8), default=0.2)
    bear = base + 0.2 * pick((~vol_up, 0.7), default=0.3) + 0.2 * pick((~obv_up, 0.8), default=0.2)
    ready = c(S.POS) >= n + 9
    return df.withColumns({"score_bullish": F.when(ready, bull).otherwise(0.5), "score_bearish": F.when(ready, bear).otherwise(0.5),
                           "volume_trend": pick((c("_v5") > c("_v0"), "increasing"), default="decreasing")}) \
        .drop("_r3", "_rmax", "_c0", "_v5", "_v0")


def adjust_confidence(conf: Column, score: Column, strength: float = 1.0) -> Column:
    w = 0.2 + 0.2 * strength
    x = conf * (1 - w) + score * w
    return pick((score < 0.3, x * 0.8), (score > 0.8, F.least(x * 1.1, F.lit(1.0))), default=x)


def volume_report(df: DataFrame) -> DataFrame:
    """Ratio, trend, OBV side, rate of change, unusual flag and quality of each row of a scored volume bundle."""
    v = c("volume_ratio")
    return df.select("ticker", "ts", "volume", "avg_volume", "volume_ratio", "volume_trend",
                     pick((c("obv") > c("obv_sma"), "bullish"), default="bearish").alias("obv_signal"), "volume_roc",
                     flag(v > 1.5).alias("unusual_volume"), pick((v > 1.2, "high"), (v < 0.8, "low"), default="normal").alias("volume_quality"))


def admissible() -> Column:
    """Volume between 0.8 and 3 times its mean, recent bars at least half of it, OBV agreeing in 60 % of them."""
    return (c("volume_ratio") >= 0.8) & (c("volume_ratio") <= 3.0) & (c("recent_ratio") >= 0.5) & (c("obv_agreement") >= 0.6 - 1e-9)


def add_admissibility(df: DataFrame) -> DataFrame:
    same = flag(F.signum(c("d")) == F.signum(c("obv") - c("obv_sma")))
    df = df.withColumns({"recent_ratio": F.avg("volume_ratio").over(S.w(5)), "_same": same})
    return df.withColumn("obv_agreement", F.avg("_same").over(S.w(10))).withColumn("admissible", flag(admissible())).drop("_same")


def add_interval_scores(df: DataFrame, n: int = 20) -> DataFrame:
    """Interval score (base 0.5, surge, trend, OBV) and daily score (spike, breakout, OBV trend) of every bar."""
    df = df.withColumns({"_r3": F.avg("volume_ratio").over(S.w(3)), "_v5": F.avg("volume").over(S.w(5)), "_v0": F.avg("volume").over(S.w(5, n - 5)),
                         "_o5": F.avg("obv").over(S.w(5)), "_o15": F.avg("obv").over(S.w(15, 5)), "_pv": S.lag("volume")})
    a = 0.5 + pick((c("_r3") > 1.5, 0.2), (c("_r3") > 1.2, 0.1), (c("_r3") < 0.5, -0.2), default=0.0) \
        + pick((c("_v5") > c("_v0"), 0.15), default=0.0) + pick((c("obv") > c("obv_sma"), 0.15), default=0.0)
    spike = div(c("_v5"), c("avg_volume"))
    breakout = (c("volume") > c("avg_volume") * 1.5) & (c("volume") > c("_pv"))
    b = 0.5 + pick((spike > 1.5, 0.25), (spike > 1.2, 0.15), (spike < 0.5, -0.2), default=0.0) + pick((breakout, 0.2), default=0.0) \
        + pick((c("_o5") > c("_o15"), 0.15), default=0.0)
    ready = c(S.POS) >= n
    return df.withColumns({"interval_score": F.when(ready, clamp(a, 0.0, 1.0)).otherwise(0.5), "daily_score": F.when(ready, clamp(b, 0.0, 1.0)).otherwise(0.5),
                           "volume_breakout": flag(breakout)}).drop("_r3", "_v5", "_v0", "_o5", "_o15", "_pv")
