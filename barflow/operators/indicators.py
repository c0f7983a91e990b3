"""Technical indicators.  Every ``add_*`` takes a blocked series (see series.py) and adds columns, so that any number
of indicators share one shuffle by (ticker, block).  None looks ahead."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from barflow.functions.scalar import clamp, div, flag, hour_of_day, pick
from barflow.operators import series as S

c = F.col


def add_change(df: DataFrame) -> DataFrame:
    """Prior close, close change and return, true range (the first bar's is its own range)."""
    df = df.withColumn("pc", S.lag("close"))
    return df.withColumns({
        "d": c("close") - c("pc"),
        "ret": div(c("close"), c("pc")) - 1,
        "tr": F.greatest(c("high") - c("low"), F.abs(c("high") - c("pc")), F.abs(c("low") - c("pc"))),
    })


def sma_from_first(x: Column, n: int) -> Column:
    """Mean of up to n rows, from the first row on."""
    return F.avg(x).over(S.w(n))


def gain() -> Column:
    return F.when(c("d") > 0, c("d")).otherwise(F.lit(0.0))


def loss() -> Column:
    return F.when(c("d") < 0, -c("d")).otherwise(F.lit(0.0))


def rsi_of(up: Column, down: Column) -> Column:
    """100 where there is gain and no loss, NULL where there is neither."""
    return F.when(down == 0, F.when(up > 0, F.lit(100.0))).otherwise(100.0 - 100.0 / (1.0 + div(up, down)))


def add_rsi_sma(df: DataFrame, n: int, out: str = "rsi") -> DataFrame:
    df = df.withColumns({"_up": S.mean(gain(), n), "_dn": S.mean(loss(), n)})
    return df.withColumn(out, rsi_of(c("_up"), c("_dn"))).drop("_up", "_dn")


def add_rsi_wilder(df: DataFrame, n: int, out: str = "rsi") -> DataFrame:
    a = S.wilder(n)
    df = S.ewm(df, {"_up": (gain(), a, False), "_dn": (loss(), a, False)})
    return df.withColumn(out, rsi_of(c("_up"), c("_dn"))).drop("_up", "_dn")


def add_macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, adjust: bool = False,
             prefix: str = "macd") -> DataFrame:
    df = S.ewm(df, {"_f": (c("close"), S.span(fast), adjust), "_s": (c("close"), S.span(slow), adjust)})
    df = df.withColumn(prefix, c("_f") - c("_s")).drop("_f", "_s")
    df = S.ewm(df, {f"{prefix}_signal": (c(prefix), S.span(signal), adjust)})
    return df.withColumn(f"{prefix}_hist", c(prefix) - c(f"{prefix}_signal"))


def add_bollinger(df: DataFrame, n: int = 20, k: float = 2.0, ddof: int = 1, prefix: str = "bb") -> DataFrame:
    df = df.withColumns({f"{prefix}_mid": S.mean(c("close"), n), "_sd": S.std(c("close"), n, ddof)})
    edges, places = bands(c(f"{prefix}_mid"), c("_sd"), k, prefix)
    return df.withColumns(edges).withColumns(places).drop("_sd")


def bands(mid: Column, sd: Column, k: float, prefix: str) -> tuple[dict[str, Column], dict[str, Column]]:
    """Bollinger bands k deviations from the middle, then what is measured against them."""
    up, lo = c(f"{prefix}_up"), c(f"{prefix}_lo")
    return ({f"{prefix}_up": mid + k * sd, f"{prefix}_lo": mid - k * sd, f"{prefix}_z": div(c("close") - mid, sd)},
            {f"{prefix}_width": div(up - lo, mid), f"{prefix}_pos": div(c("close") - lo, up - lo),
             f"{prefix}_pierce": flag((c("close") > up) | (c("close") < lo))})


def add_stochastic(df: DataFrame, k: int = 14, d: int = 3) -> DataFrame:
    df = df.withColumns({"_lo": S.full(F.min("low"), c("low"), k), "_hi": S.full(F.max("high"), c("high"), k)})
    df = df.withColumn("stoch_k", 100 * div(c("close") - c("_lo"), c("_hi") - c("_lo"))).drop("_lo", "_hi")
    return df.withColumn("stoch_d", S.mean(c("stoch_k"), d))


def add_adx(df: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's ADX; needs add_change."""
    a = S.wilder(n)
    df = df.withColumns({"_u": c("high") - S.lag("high"), "_v": S.lag("low") - c("low")})
    df = df.withColumns({
        "_pdm": F.when((c("_u") > c("_v")) & (c("_u") > 0), c("_u")).otherwise(F.lit(0.0)),
        "_mdm": F.when((c("_v") > c("_u")) & (c("_v") > 0), c("_v")).otherwise(F.lit(0.0))})
    df = S.ewm(df, {"_atr": (c("tr"), a, False), "_ps": (c("_pdm"), a, False), "_ms": (c("_mdm"), a, False)})
    df = df.withColumns({"plus_di": F.coalesce(100 * div(c("_ps"), c("_atr")), F.lit(0.0)),
                         "minus_di": F.coalesce(100 * div(c("_ms"), c("_atr")), F.lit(0.0))})
    df = df.withColumn("_dx", 100 * F.abs(c("plus_di") - c("minus_di")) / (c("plus_di") + c("minus_di") + 1e-10))
    return S.ewm(df, {"adx": (c("_dx"), a, False)}).drop("_u", "_v", "_pdm", "_mdm", "_atr", "_ps", "_ms", "_dx")


def add_keltner(df: DataFrame, n: int = 20, mult: float = 2.0) -> DataFrame:
    """Distance outside the channel in ATRs and the share of the last n bars outside."""
    df = S.ewm(df, {"_m": (c("close"), S.span(n), False), "_a": (c("tr"), S.span(n), False)})
    up, lo = c("_m") + mult * c("_a"), c("_m") - mult * c("_a")
    df = df.withColumn("keltner_pos", pick((c("close") > up, div(c("close") - up, c("_a"))),
                                           (c("close") < lo, div(c("close") - lo, c("_a"))), default=0.0))
    df = df.withColumn("_out", flag((c("close") > up) | (c("close") < lo)))
    return df.withColumn("keltner_pct", S.mean(c("_out"), n)).drop("_m", "_a", "_out")


def add_hurst(df: DataFrame, window: int = 120, out: str = "hurst") -> DataFrame:
    """Hurst exponent over the ``window`` closes before the current bar, 0.5 until they exist.

    Twice the slope of ln sqrt(std of lagged differences) on ln lag for lags 2..59: about 7,000 differences per row, so
    the windows go through Arrow in batches and numpy does all rows of a batch at once."""
    lags = np.arange(2, min(window // 2, 100))
    x = np.log(lags) - np.log(lags).mean()

    @F.pandas_udf("double")
    def slope(windows: pd.Series) -> pd.Series:
        full = windows.map(len).to_numpy() == window if len(windows) else np.array([], bool)
        res = np.full(len(windows), 0.5)
        if full.any():
            a = np.stack(windows[full].to_list())
            tau = np.stack([np.log(np.maximum((a[:, k:] - a[:, :-k]).std(axis=1), 1e-300)) / 2 for k in lags], axis=1)
            h = 2.0 * (tau * x).sum(axis=1) / (x * x).sum()
            res[full] = np.where(a.std(axis=1) > 0, h, 0.5)
        return pd.Series(res)

    return df.withColumn("_h", F.collect_list("close").over(S.w(window, 1))).withColumn(out, slope("_h")).drop("_h")


def zscore(x: Column, n: int = 60, least: int = 20) -> Column:
    """Rolling z-score, 0 until ``least`` values are present."""
    n_seen = F.count(x).over(S.w(n))
    z = (x - F.avg(x).over(S.w(n))) / (F.stddev_samp(x).over(S.w(n)) + 1e-10)
    return F.coalesce(F.when(n_seen >= least, z), F.lit(0.0))


def add_obv(df: DataFrame, smooth: int = 10) -> DataFrame:
    """On-balance volume from the first bar (level 0), its mean, its last step and its mean step over 3 bars."""
    df = S.running_sum(df, {"obv": F.coalesce(F.signum(c("d")), F.lit(0.0)) * c("volume")})
    df = df.withColumn("_p", S.lag("obv"))
    df = df.withColumns({"obv_sma": S.mean(c("obv"), smooth), "obv_delta": c("obv") - c("_p")}).drop("_p")
    return df.withColumn("obv_slope3", div(c("obv") - S.lag("obv", 2), 2))


def add_pvt(df: DataFrame) -> DataFrame:
    return S.running_sum(df, {"pvt": F.coalesce(c("ret"), F.lit(0.0)) * c("volume")})


def typical() -> Column:
    return (c("high") + c("low") + c("close")) / 3


def vwap_carry() -> dict[str, Column]:
    """Row-local amounts whose totals before a block a running VWAP needs."""
    return {"_cpv": c("close") * c("volume"), "_ctv": typical() * c("volume"), "_cv": c("volume")}


def add_running_vwap(df: DataFrame) -> DataFrame:
    """VWAP since the first bar, on closes and on typical prices.  Needs blocked(..., carry=vwap_carry())."""
    vol = c("_cv") + F.sum("volume").over(S.running())
    return df.withColumns({
        "vwap_close": div(c("_cpv") + F.sum(c("close") * c("volume")).over(S.running()), vol),
        "vwap_typical": div(c("_ctv") + F.sum(typical() * c("volume")).over(S.running()), vol),
    }).drop("_cpv", "_ctv", "_cv")


def add_rolling_vwap(df: DataFrame, n: int = 20) -> DataFrame:
    df = df.withColumn("vwap_roll", div(S.full(F.sum(c("close") * c("volume")), c("close"), n),
                                        S.full(F.sum("volume"), c("volume"), n)))
    return df.withColumn("dist_vwap", div(c("close") - c("vwap_roll"), c("vwap_roll")))


def add_percent_rank(df: DataFrame, x: str, n: int, out: str) -> DataFrame:
    """Rank of the newest of the last n values in (0, 1], ties averaged."""
    df = df.withColumn("_v", F.when(F.count(x).over(S.w(n)) == n, F.collect_list(x).over(S.w(n))))
    less = F.size(F.filter("_v", lambda v: v < c(x)))
    same = F.size(F.filter("_v", lambda v: v == c(x)))
    return df.withColumn(out, F.when(c("_v").isNotNull(), (less + (same + 1) / 2) / n)).drop("_v")


def add_cci(df: DataFrame, n: int = 20) -> DataFrame:
    """(typical - mean) / (0.015 * mean absolute deviation)."""
    df = df.withColumn("_tp", typical())
    df = df.withColumns({"_m": S.mean(c("_tp"), n), "_v": F.collect_list("_tp").over(S.w(n))})
    mad = F.aggregate("_v", F.lit(0.0), lambda acc, v: acc + F.abs(v - c("_m"))) / n
    return df.withColumn("cci", div(c("_tp") - c("_m"), 0.015 * mad)).drop("_tp", "_m", "_v")


def add_range_position(df: DataFrame, n: int = 20) -> DataFrame:
    df = df.withColumns({"support": S.full(F.min("low"), c("low"), n), "resistance": S.full(F.max("high"), c("high"), n)})
    return df.withColumns(range_places())


def range_places() -> dict[str, Column]:
    """Where the close stands between support and resistance and in its own bar; both ranges as shares of it."""
    return {
        "range_pos": div(c("close") - c("support"), c("resistance") - c("support")),
        "range_rel": div(c("resistance") - c("support"), c("close")),
        "close_pos": div(c("close") - c("low"), c("high") - c("low")),
        "spread": div(c("high") - c("low"), c("close"))}


def add_trend_align(df: DataFrame) -> DataFrame:
    """1 where SMA 5 > 10 > 20, -1 where 5 < 10 < 20, else 0; distance to SMA 20 as a share."""
    df = df.withColumns({f"sma{n}": S.mean(c("close"), n) for n in (5, 10, 20)})
    up = (c("sma5") > c("sma10")) & (c("sma10") > c("sma20"))
    down = (c("sma5") < c("sma10")) & (c("sma10") < c("sma20"))
    return df.withColumns({"trend_align": pick((up, 1), (down, -1), default=0),
                           "dist_sma20": div(c("close") - c("sma20"), c("sma20"))})


def add_slopes(df: DataFrame, n: int = 5) -> DataFrame:
    """Least-squares slope of close and OBV over the last n bars; divergence where they have opposite signs.

    Bars are evenly spaced, so a slope is a weighted sum with whole weights: that of whole numbers (OBV) which balance is 0, where a regression leaves noise."""
    def slope(x: str) -> Column:
        total = F.lit(0.0)
        for k in range(n - 1, -1, -1):
            if n - 1 - 2 * k:
                total = total + (n - 1 - 2 * k) * (S.lag(x, k) if k else c(x))
        return total / (n * (n * n - 1) / 6)
    df = df.withColumns({"price_slope": slope("close"), "obv_slope": slope("obv")})
    return df.withColumn("divergence", pick(((c("obv_slope") > 0) & (c("price_slope") < 0), "bullish"),
                                            ((c("obv_slope") < 0) & (c("price_slope") > 0), "bearish"), default="none"))


def add_volume(df: DataFrame) -> DataFrame:
    df = S.ewm(df, {"volume_ema16": (c("volume"), S.span(16), True)})
    df = df.withColumns({f"avg_volume_{n}": sma_from_first(c("volume"), n) for n in (20, 24, 50)})
    return df.withColumns({
        "volume_spike": div(c("volume"), c("avg_volume_20")),
        "volume_ratio_ema": div(c("volume"), c("volume_ema16")),
        "volume_mom3": div(c("volume"), S.lag("volume", 3)) - 1,
        "volume_roc10": (div(c("volume"), S.lag("volume", 10)) - 1) * 100})


def add_gap_and_range(df: DataFrame) -> DataFrame:
    """Gap to the prior close (0 on the first bar), narrow-range flags, 52-week extremes."""
    df = df.withColumns({"gap_pct": F.coalesce(div(c("open") - c("pc"), c("pc")) * 100, F.lit(0.0)),
                         "bar_range": c("high") - c("low"),
                         "high_52w": F.max("high").over(S.w(252)), "low_52w": F.min("low").over(S.w(252))})
    narrow = {f"nr{n}": flag(c("bar_range") == S.full(F.min("bar_range"), c("bar_range"), n)) for n in (4, 7)}
    return df.withColumns({**narrow,
                           "pct_from_high": div(c("close") - c("high_52w"), c("high_52w")) * 100,
                           "pct_from_low": div(c("close") - c("low_52w"), c("low_52w")) * 100})


def roc(k: int) -> Column:
    return div(c("close"), S.lag("close", k)) - 1


def add_trend_counts(df: DataFrame, n: int = 4) -> DataFrame:
    """Higher highs, lower lows and higher lows among the last n bars; trend strength in [-1, 1]."""
    df = df.withColumns({"_hh": flag(c("high") > S.lag("high")), "_ll": flag(c("low") < S.lag("low")),
                         "_hl": flag(c("low") > S.lag("low"))})
    df = df.withColumns({out: S.full(F.sum(x), c(x), n) for out, x in
                         (("higher_highs", "_hh"), ("lower_lows", "_ll"), ("higher_lows", "_hl"))})
    return df.withColumn("trend_strength", (c("higher_highs") - c("lower_lows")) / n).drop("_hh", "_ll", "_hl")


def add_volatility(df: DataFrame, n: int = 16, base: int = 48) -> DataFrame:
    df = df.withColumn("volatility", S.std(c("ret"), n))
    return df.withColumn("vol_ratio", div(c("volatility"), S.mean(c("volatility"), base)))


def realised_vol(x: Column, bars_per_day: int = 26) -> Column:
    return x * F.sqrt(F.lit(252.0 * bars_per_day))


def extreme_move() -> Column:
    return flag(F.abs(c("ret")) > 0.01)


def time_adjusted_volume_mult(ts: Column, base: Column | float) -> Column:
    """Volume requirement that falls up to 30 % along the session, never below 1.1 once it is open."""
    h, b = hour_of_day(ts), base if isinstance(base, Column) else F.lit(float(base))
    elapsed = F.least(h - 9.5, F.lit(6.5))
    return F.when(h < 9.5, b).otherwise(F.greatest(b * (1 - 0.3 * F.sqrt(F.greatest(elapsed, F.lit(0.0)) / 6.5)), F.lit(1.1)))


def adaptive_threshold(atr_pct: Column, mult: float = 0.25, lo: float = 0.05, hi: float = 0.50,
                       fallback: float = 0.1) -> Column:
    """Direction threshold in percent, from ATR in percent of price."""
    return F.coalesce(clamp(atr_pct * mult, lo, hi), F.lit(fallback))


def breakout_buffer(atr: Column, price: Column, share: float, mult: float) -> Column:
    return F.greatest(price * share, atr * mult)


# ---------------------------------------------------------------- session indicators (bounded by the clock)

def add_session(bars: DataFrame, opening_bars: int = 3) -> DataFrame:
    """Session open, running high and low, opening range, session VWAP; a session is one (ticker, date)."""
    key = Window.partitionBy("ticker", "date")
    ws = key.orderBy("ts")
    run = ws.rowsBetween(Window.unboundedPreceding, 0)
    df = bars.withColumn("date", F.to_date("ts"))
    df = df.withColumns({
        "bar_no": F.row_number().over(ws), "opening_price": F.first("open").over(run),
        "running_hod": F.max("high").over(run), "running_lod": F.min("low").over(run),
        "session_vwap": div(F.sum(typical() * c("volume")).over(run), F.sum("volume").over(run))})
    head = c("bar_no") <= opening_bars
    return df.withColumns({"or_high": F.max(F.when(head, c("high"))).over(key),
                           "or_low": F.min(F.when(head, c("low"))).over(key)})


# ---------------------------------------------------------------- bundles

def hourly_bundle(bars: DataFrame, interval_s: int = 3600) -> DataFrame:
    """Hourly indicators plus the candle flags and OBV that the alert rules read.  Returns a blocked frame."""
    from barflow.operators.candles import add_reversal_flags
    df = add_change(S.blocked(bars, interval_s))
    df = df.withColumns({"prior_close": c("pc"), "sma_24": sma_from_first(c("close"), 24),
                         "sma_168": sma_from_first(c("close"), 168), "avg_volume_24": sma_from_first(c("volume"), 24)})
    df = S.ewm(df, {"ema_24": (c("close"), S.span(24), False)})
    df = add_rsi_wilder(df, 14, "rsi_14")
    df = df.withColumns({"volume_spike": div(c("volume"), c("avg_volume_24")),
                         "gap_pct": F.coalesce(div(c("open") - c("pc"), c("pc")) * 100, F.lit(0.0))})
    return add_reversal_flags(add_obv(df))


def daily_bundle(bars: DataFrame, interval_s: int = S.DAY, obv: bool = True) -> DataFrame:
    """About thirty daily indicators over one shuffle by (ticker, block).  Returns a blocked frame.

    All first-level recurrences run in one scan call, so they share its sorts."""
    from barflow.operators.candles import add_reversal_flags
    df = add_change(S.blocked(bars, interval_s))
    w14 = S.wilder(14)
    df = S.ewm(df, {**{f"ema_{n}": (c("close"), S.span(n), False) for n in (20, 50, 100, 200)},
                    "_up": (gain(), w14, False), "_dn": (loss(), w14, False), "atr_14": (c("tr"), w14, False),
                    "_f": (c("close"), S.span(12), False), "_s": (c("close"), S.span(26), False)})
    df = df.withColumns({"rsi_14": rsi_of(c("_up"), c("_dn")), "macd": c("_f") - c("_s")})
    df = S.ewm(df, {"macd_signal": (c("macd"), S.span(9), False)})
    df = df.withColumns({"prior_close": c("pc"), **{f"sma_{n}": sma_from_first(c("close"), n) for n in (20, 50, 100, 200)},
                         **{f"avg_volume_{n}": sma_from_first(c("volume"), n) for n in (20, 50)},
                         "rsi_slope": c("rsi_14") - S.lag("rsi_14"), "macd_hist": c("macd") - c("macd_signal"),
                         "bb_mid": S.mean(c("close"), 20), "_sd": S.std(c("close"), 20, 0)})
    up, lo = c("bb_mid") + 2 * c("_sd"), c("bb_mid") - 2 * c("_sd")
    df = df.withColumns({"volume_spike": div(c("volume"), c("avg_volume_20")), "bb_up": up, "bb_lo": lo,
                         "bb_pos": div(c("close") - lo, up - lo), "bb_pierce": flag((c("close") > up) | (c("close") < lo))})
    df = df.drop("_up", "_dn", "_f", "_s", "_sd")
    if obv:
        df = add_obv(df)
    return add_reversal_flags(add_gap_and_range(df))


def intraday_bundle(bars: DataFrame, interval_s: int = 900) -> DataFrame:
    """Session-aware bundle: session columns first (by ticker and date), then the rolling ones.  Blocked frame."""
    from barflow.operators.candles import add_reversal_flags
    df = add_change(S.blocked(add_session(bars), interval_s))
    df = df.withColumn("prior_close", c("pc"))
    df = S.ewm(df, {"ema_9": (c("close"), S.span(9), False), "ema_20": (c("close"), S.span(20), False)})
    df = df.withColumns({"sma_5": S.mean(c("close"), 5), "sma_20": S.mean(c("close"), 20)})
    df = add_rsi_wilder(df, 14, "rsi_14")
    df = df.withColumn("rsi_slope", c("rsi_14") - S.lag("rsi_14"))
    df = S.ewm(df, {"atr_14": (c("tr"), S.wilder(14), False)})
    df = add_bollinger(df, 20, 2.0, ddof=0)
    df = df.withColumns({"avg_volume_20": S.mean(c("volume"), 20),
                         "gap_pct": div(c("open") - c("pc"), c("pc")) * 100, "bar_range": c("high") - c("low")})
    df = df.withColumns({"volume_spike": div(c("volume"), c("avg_volume_20")),
                         **{f"nr{n}": flag(c("bar_range") == S.full(F.min("bar_range"), c("bar_range"), n))
                            for n in (4, 7)}})
    return add_reversal_flags(add_obv(df))


def volume_bundle(bars: DataFrame, interval_s: int = S.DAY, n: int = 20) -> DataFrame:
    """Volume ratio and means, OBV and its mean, volume change, PVT and running VWAP.  Blocked frame."""
    df = add_change(S.blocked(bars, interval_s, carry=vwap_carry()))
    df = add_running_vwap(df)
    df = df.withColumns({"avg_volume": S.mean(c("volume"), n), "volume_sma_5": S.mean(c("volume"), 5),
                         "volume_sma_20": S.mean(c("volume"), 20),
                         "volume_roc": (div(c("volume"), S.lag("volume", 10)) - 1) * 100})
    df = df.withColumn("volume_ratio", div(c("volume"), c("avg_volume")))
    step = F.coalesce(F.signum(c("d")), F.lit(0.0)) * c("volume")
    df = S.running_sum(df, {"obv": step, "pvt": F.coalesce(c("ret"), F.lit(0.0)) * c("volume")})
    return df.withColumn("obv_sma", S.mean(c("obv"), 10))
