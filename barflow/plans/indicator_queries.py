"""Bars, resampling and indicators: queries and their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from barflow.functions.scalar import div, r
from barflow.operators import bars as B, indicators as I, series as S
from barflow.plans import sql as Q
from barflow.plans.registry import query
from barflow.sources import views as V

c = F.col


def out(df, *cols, digits=4, **named):
    """Key columns plus rounded numbers, halo rows dropped."""
    if S.HALO in df.columns:
        S.check_reach(df)
        df = df.filter(~c(S.HALO))
    picked = {**{k: c(k) for k in cols}, **named}
    return df.select("ticker", "ts", *[r(v.cast("double"), digits).alias(k) for k, v in picked.items()])


def sel(digits=4, **named):
    return ", ".join(f"round(CAST({v} AS DOUBLE), {digits}) AS {k}" for k, v in named.items())


def day(spark, sf):
    return S.blocked(V.bars_1d(spark, sf))


def changed(spark, sf):
    return I.add_change(day(spark, sf))


# ------------------------------------------------------------------ bars

@query("bars_tumbling", f"WITH {Q.BARS_15M} SELECT ticker, ts, round(open,4) AS open, round(high,4) AS high, round(low,4) AS low, "
       "round(close,4) AS close, volume FROM b")
def bars_tumbling(spark, sf):
    return V.bars_15m(spark, sf).select("ticker", "ts", *[r(c(x)).alias(x) for x in ("open", "high", "low", "close")], "volume")


@query("bars_hourly_counts", f"WITH {Q.TICKS} SELECT ticker, time_bucket(INTERVAL '60 minutes', ts, TIMESTAMP '1970-01-01') AS ts, "
       "count(*) AS trades, round(max(price),4) AS high, round(min(price),4) AS low FROM t GROUP BY 1, 2")
def bars_hourly_counts(spark, sf):
    b = B.tumbling_bars(V.event_ticks(spark, sf), "1 hour", "event_id")
    return b.select("ticker", "ts", "trades", r(c("high")).alias("high"), r(c("low")).alias("low"))


@query("bars_consolidated_venues", """WITH x AS (SELECT CAST(l_suppkey AS VARCHAR) AS ticker, l_shipdate AS ts, l_returnflag AS venue,
 l_extendedprice / l_quantity AS px, l_quantity AS q, l_orderkey, l_linenumber, l_partkey FROM lineitem),
 v AS (SELECT ticker, ts, venue, first(px ORDER BY l_orderkey, l_linenumber, l_partkey) AS open, max(px) AS high, min(px) AS low,
 last(px ORDER BY l_orderkey, l_linenumber, l_partkey) AS close, sum(q) AS volume FROM x GROUP BY 1, 2, 3)
 SELECT ticker, ts, round(first(open ORDER BY venue), 4) AS open, round(max(high), 4) AS high, round(min(low), 4) AS low,
 round(last(close ORDER BY venue), 4) AS close, sum(volume) AS volume, round(sum(close * volume) / nullif(sum(volume), 0), 4) AS vwap,
 count(*) AS venues FROM v GROUP BY 1, 2""")
def bars_consolidated_venues(spark, sf):
    b = B.consolidate_venues(V.venue_bars(spark, sf))
    return b.select("ticker", "ts", *[r(c(x)).alias(x) for x in ("open", "high", "low", "close")], "volume",
                    r(c("vwap")).alias("vwap"), "venues")


@query("bars_upsampled", f"""WITH {Q.BARS_1H}, n AS (SELECT *, lead(ts) {Q.ROW} AS nxt FROM b),
 g AS (SELECT ticker, close, volume, ts AS t0, unnest(generate_series(ts, coalesce(nxt - INTERVAL '15 minutes', ts + INTERVAL '45 minutes'),
 INTERVAL '15 minutes')) AS ts FROM n)
 SELECT ticker, ts, round(close, 4) AS close, CASE WHEN ts < t0 + INTERVAL '1 hour' THEN round(volume / 4, 4) ELSE 0.0 END AS volume,
 CASE WHEN ts < t0 + INTERVAL '1 hour' THEN 0 ELSE 1 END AS filled FROM g""")
def bars_upsampled(spark, sf):
    return B.upsample(V.bars_1h(spark, sf)).select("ticker", "ts", r(c("close")).alias("close"), r(c("volume")).alias("volume"),
                                                   "filled")


@query("bars_weekly_rollup", f"WITH {Q.WEEKS} SELECT ticker, ts, round(open,4) AS open, round(high,4) AS high, round(low,4) AS low, "
       "round(close,4) AS close, volume FROM wk")
def bars_weekly_rollup(spark, sf):
    return V.bars_1w(spark, sf).select("ticker", "ts", *[r(c(x)).alias(x) for x in ("open", "high", "low", "close")], "volume")


@query("session_bar_number", f"""WITH {Q.BARS_15M} SELECT ticker, ts, CAST(CAST(ts AS DATE) AS VARCHAR) AS session,
 CAST(row_number() OVER (PARTITION BY ticker, CAST(ts AS DATE) ORDER BY ts) AS INTEGER) AS bar_no FROM b""")
def session_bar_number(spark, sf):
    return B.session_number(V.bars_15m(spark, sf)).select("ticker", "ts", c("date").cast("string").alias("session"), "bar_no")


# ------------------------------------------------------------------ moving averages and oscillators

@query("sma", f"WITH {Q.BARS} SELECT ticker, ts, " + sel(
    prior_close=Q.lag("close"), **{f"sma_{n}": f"avg(close) {Q.over(n)}" for n in (20, 24, 50, 100, 168, 200)},
    full_10=Q.mean("close", 10), full_30=Q.mean("close", 30)) + " FROM b")
def sma(spark, sf):
    return out(day(spark, sf), prior_close=S.lag("close"),
               **{f"sma_{n}": I.sma_from_first(c("close"), n) for n in (20, 24, 50, 100, 168, 200)},
               full_10=S.mean(c("close"), 10), full_30=S.mean(c("close"), 30))


@query("ema", f"WITH {Q.BARS}, {Q.numbered()} SELECT ticker, ts, " + sel(
    **{f"ema_{n}": Q.ema("close", S.span(n)) for n in (20, 50, 100, 200)},
    adj_8=Q.ema("close", S.span(8), True), adj_24=Q.ema("close", S.span(24), True)) + " FROM s")
def ema(spark, sf):
    df = S.ewm(day(spark, sf), {**{f"ema_{n}": (c("close"), S.span(n), False) for n in (20, 50, 100, 200)},
                                "adj_8": (c("close"), S.span(8), True), "adj_24": (c("close"), S.span(24), True)})
    return out(df, "ema_20", "ema_50", "ema_100", "ema_200", "adj_8", "adj_24")


_RSI = f"""WITH {Q.BARS}, {Q.numbered()},
 g AS (SELECT *, {Q.mean(Q.GAIN, 14)} AS u, {Q.mean(Q.LOSS, 14)} AS v, {Q.ema(Q.GAIN, S.wilder(12))} AS wu,
 {Q.ema(Q.LOSS, S.wilder(12))} AS wv FROM s),
 q AS (SELECT *, {Q.rsi('u', 'v')} AS rsi_sma, {Q.rsi('wu', 'wv')} AS rsi_wilder FROM g)
 SELECT ticker, ts, """ + sel(rsi_sma="rsi_sma", rsi_wilder="rsi_wilder", slope=f"rsi_sma - {Q.lag('rsi_sma')}",
                             momentum=f"rsi_wilder - {Q.lag('rsi_wilder', 3)}") + " FROM q"


@query("rsi", _RSI)
def rsi(spark, sf):
    df = I.add_rsi_wilder(I.add_rsi_sma(changed(spark, sf), 14, "rsi_sma"), 12, "rsi_wilder")
    df = df.withColumns({"slope": c("rsi_sma") - S.lag("rsi_sma"), "momentum": c("rsi_wilder") - S.lag("rsi_wilder", 3)})
    return out(df, "rsi_sma", "rsi_wilder", "slope", "momentum")


def _macd_sql():
    sets = {"a": (12, 26, 9, False), "b2": (10, 24, 8, True), "c2": (8, 17, 6, True)}
    line = ", ".join(f"{Q.ema('close', S.span(f), adj)} - {Q.ema('close', S.span(s), adj)} AS m_{k}"
                     for k, (f, s, _, adj) in sets.items())
    sig = ", ".join(f"{Q.ema(f'm_{k}', S.span(g), adj)} AS g_{k}" for k, (_, _, g, adj) in sets.items())
    return f"""WITH {Q.BARS}, {Q.numbered()}, l AS (SELECT ticker, ts, r, {line} FROM s), q AS (SELECT *, {sig} FROM l)
 SELECT ticker, ts, """ + sel(macd="m_a", macd_signal="g_a", macd_hist="m_a - g_a", opt_hist="m_b2 - g_b2",
                             opt_momentum=f"m_b2 - {Q.lag('m_b2', 2)}", fast_hist="m_c2 - g_c2") + " FROM q"


@query("macd", _macd_sql())
def macd(spark, sf):
    df = I.add_macd(day(spark, sf))
    df = I.add_macd(df, 10, 24, 8, True, "opt")
    df = I.add_macd(df, 8, 17, 6, True, "fast")
    df = df.withColumn("opt_momentum", c("opt") - S.lag("opt", 2))
    return out(df, "macd", "macd_signal", "macd_hist", "opt_hist", "opt_momentum", "fast_hist")


@query("atr", f"WITH {Q.BARS}, {Q.numbered()}, q AS (SELECT *, {Q.TR} AS tr FROM s), z AS (SELECT *, {Q.mean('tr', 14)} AS a FROM q) "
       "SELECT ticker, ts, " + sel(bar_range="high - low", tr="tr", atr_sma="a", atr_ema=Q.ema("tr", S.span(12)),
                                  atr_wilder=Q.ema("tr", S.wilder(14)), atr_pct=f"{Q.div('a', 'close')} * 100") + " FROM z")
def atr(spark, sf):
    df = changed(spark, sf).withColumn("atr_sma", S.mean(c("tr"), 14))
    df = S.ewm(df, {"atr_ema": (c("tr"), S.span(12), False), "atr_wilder": (c("tr"), S.wilder(14), False)})
    return out(df, "tr", "atr_sma", "atr_ema", "atr_wilder", bar_range=c("high") - c("low"),
               atr_pct=div(c("atr_sma"), c("close")) * 100)


def _bb_sql():
    sets = {"std": (20, 2.0), "opt": (18, 2.1), "fast": (15, 2.5), "wide": (20, 3.0)}
    raw = ", ".join(f"{Q.mean('close', n)} AS m_{k}, {Q.std('close', n)} AS d_{k}" for k, (n, _) in sets.items())
    cols = {}
    for k, (_, w) in sets.items():
        cols.update({f"{k}_mid": f"m_{k}", f"{k}_up": f"m_{k} + {w} * d_{k}", f"{k}_lo": f"m_{k} - {w} * d_{k}",
                     f"{k}_width": Q.div(f"(m_{k} + {w} * d_{k}) - (m_{k} - {w} * d_{k})", f"m_{k}"),
                     f"{k}_pos": Q.div(f"close - (m_{k} - {w} * d_{k})", f"(m_{k} + {w} * d_{k}) - (m_{k} - {w} * d_{k})")})
    return (f"WITH {Q.BARS}, q AS (SELECT *, {raw}, {Q.full('stddev_pop', 'close', 20)} AS dp FROM b) SELECT ticker, ts, " + sel(
        **cols, z=Q.div("close - m_std", "d_std"), pop_up="m_std + 2 * dp",
        pierce="CASE WHEN close > m_std + 2 * d_std OR close < m_std - 2 * d_std THEN 1 ELSE 0 END") + " FROM q")


@query("bollinger", _bb_sql())
def bollinger(spark, sf):
    df = day(spark, sf)
    for k, (n, w) in {"std": (20, 2.0), "opt": (18, 2.1), "fast": (15, 2.5), "wide": (20, 3.0)}.items():
        df = I.add_bollinger(df, n, w, 1, k)
    df = I.add_bollinger(df, 20, 2.0, 0, "pop")
    cols = [f"{k}_{x}" for k in ("std", "opt", "fast", "wide") for x in ("mid", "up", "lo", "width", "pos")]
    return out(df, *cols, "pop_up", z=c("std_z"), pierce=c("std_pierce"))


_LO, _HI = Q.full("min", "low", 14), Q.full("max", "high", 14)
_STOCH = f"q0 AS (SELECT *, {_LO} AS lo, {_HI} AS hi FROM b), q AS (SELECT *, 100 * (close - lo) / nullif(hi - lo, 0) AS k FROM q0)"


@query("stochastic", f"WITH {Q.BARS}, {_STOCH} SELECT ticker, ts, " + sel(stoch_k="k", stoch_d=Q.mean("k", 3)) + " FROM q")
def stochastic(spark, sf):
    return out(I.add_stochastic(day(spark, sf), 14, 3), "stoch_k", "stoch_d")


ADX_SQL = f"""u AS (SELECT *, {Q.TR} AS tr, high - lag(high) {Q.ROW} AS uu, lag(low) {Q.ROW} - low AS dd FROM s),
 m AS (SELECT *, CASE WHEN uu > dd AND uu > 0 THEN uu ELSE 0.0 END AS pdm, CASE WHEN dd > uu AND dd > 0 THEN dd ELSE 0.0 END AS mdm FROM u),
 w AS (SELECT *, {Q.ema('tr', S.wilder(14))} AS wa, {Q.ema('pdm', S.wilder(14))} AS wp, {Q.ema('mdm', S.wilder(14))} AS wm FROM m),
 di AS (SELECT *, coalesce(100 * wp / nullif(wa, 0), 0) AS pdi, coalesce(100 * wm / nullif(wa, 0), 0) AS mdi FROM w),
 dx AS (SELECT *, 100 * abs(pdi - mdi) / (pdi + mdi + 1e-10) AS dxv FROM di),
 ax AS (SELECT *, {Q.ema('dxv', S.wilder(14))} AS adx FROM dx)"""


@query("adx", f"WITH {Q.BARS}, {Q.numbered()}, {ADX_SQL} SELECT ticker, ts, " + sel(
    plus_di="pdi", minus_di="mdi", adx="adx") + f", CASE WHEN adx > {Q.lag('adx', 5)} THEN 1 ELSE 0 END AS rising FROM ax")
def adx(spark, sf):
    df = I.add_adx(changed(spark, sf)).withColumn("rising", F.when(c("adx") > S.lag("adx", 5), 1).otherwise(0))
    return S.unblock(df).select("ticker", "ts", *[r(c(x)).alias(x) for x in ("plus_di", "minus_di", "adx")], "rising")


KELT_SQL = f"""ke AS (SELECT *, {Q.ema('close', S.span(20))} AS km, {Q.ema('tr', S.span(20))} AS ka FROM {{src}}),
 kp AS (SELECT *, CASE WHEN close > km + 2 * ka THEN coalesce((close - (km + 2 * ka)) / nullif(ka, 0), 0)
   WHEN close < km - 2 * ka THEN coalesce((close - (km - 2 * ka)) / nullif(ka, 0), 0) ELSE 0.0 END AS keltner_pos,
   CASE WHEN close > km + 2 * ka OR close < km - 2 * ka THEN 1 ELSE 0 END AS outside FROM ke),
 kk AS (SELECT *, {Q.mean('outside', 20)} AS keltner_pct FROM kp)"""


@query("keltner", f"WITH {Q.BARS}, {Q.numbered()}, v AS (SELECT *, {Q.TR} AS tr FROM s), {KELT_SQL.format(src='v')} SELECT ticker, ts, "
       + sel(keltner_pos="keltner_pos", keltner_pct="keltner_pct") + " FROM kk")
def keltner(spark, sf):
    return out(I.add_keltner(changed(spark, sf)), "keltner_pos", "keltner_pct")


@query("rolling_zscore", f"""WITH {Q.BARS} SELECT ticker, ts, round(coalesce(CASE WHEN count(close) {Q.over(60)} >= 20 THEN
 (close - avg(close) {Q.over(60)}) / (stddev_samp(close) {Q.over(60)} + 1e-10) END, 0), 4) AS z FROM b""")
def rolling_zscore(spark, sf):
    return out(day(spark, sf), z=I.zscore(c("close"), 60, 20))


OBV_SQL = f"o AS (SELECT *, sum(coalesce(sign(d), 0) * volume) {Q.RUN} AS obv FROM s)"


@query("obv", f"WITH {Q.BARS}, {Q.numbered()}, {OBV_SQL} SELECT ticker, ts, " + sel(
    obv="obv", obv_sma=Q.mean("obv", 10), obv_delta=f"obv - {Q.lag('obv')}",
    obv_slope3=f"(obv - {Q.lag('obv', 2)}) / 2") + " FROM o")
def obv(spark, sf):
    return out(I.add_obv(changed(spark, sf)), "obv", "obv_sma", "obv_delta", "obv_slope3")


_SES = "PARTITION BY ticker, CAST(ts AS DATE)"
_SRUN = f"OVER ({_SES} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
SESSION_SQL = f"""se0 AS (SELECT *, CAST(ts AS DATE) AS date, row_number() OVER ({_SES} ORDER BY ts) AS bar_no,
 first(open) {_SRUN} AS opening_price, max(high) {_SRUN} AS running_hod, min(low) {_SRUN} AS running_lod,
 sum((high + low + close) / 3 * volume) {_SRUN} / nullif(sum(volume) {_SRUN}, 0) AS session_vwap FROM b),
 se AS (SELECT *, max(CASE WHEN bar_no <= {{k}} THEN high END) OVER ({_SES}) AS or_high,
 min(CASE WHEN bar_no <= {{k}} THEN low END) OVER ({_SES}) AS or_low FROM se0)"""


@query("session_levels", f"WITH {Q.BARS_15M}, {SESSION_SQL.format(k=3)} SELECT ticker, ts, " + sel(
    **{k: k for k in ("opening_price", "running_hod", "running_lod", "session_vwap", "or_high", "or_low")}) + " FROM se")
def session_levels(spark, sf):
    return out(I.add_session(V.bars_15m(spark, sf)), "opening_price", "running_hod", "running_lod", "session_vwap", "or_high", "or_low")


@query("vwap", f"WITH {Q.BARS} SELECT ticker, ts, " + sel(
    vwap_close=f"sum(close * volume) {Q.RUN} / nullif(sum(volume) {Q.RUN}, 0)",
    vwap_typical=f"sum((high + low + close) / 3 * volume) {Q.RUN} / nullif(sum(volume) {Q.RUN}, 0)",
    vwap_roll=f"({Q.full('sum', 'close * volume', 20)}) / nullif({Q.full('sum', 'volume', 20)}, 0)",
    dist_vwap=f"close / nullif(({Q.full('sum', 'close * volume', 20)}) / nullif({Q.full('sum', 'volume', 20)}, 0), 0) - 1") + " FROM b")
def vwap(spark, sf):
    df = I.add_running_vwap(S.blocked(V.bars_1d(spark, sf), carry=I.vwap_carry()))
    return out(I.add_rolling_vwap(df), "vwap_close", "vwap_typical", "vwap_roll", "dist_vwap")


@query("volume_indicators", f"WITH {Q.BARS}, {Q.numbered()} SELECT ticker, ts, " + sel(
    **{f"avg_volume_{n}": f"avg(volume) {Q.over(n)}" for n in (20, 24, 50)},
    volume_spike=Q.div("volume", f"avg(volume) {Q.over(20)}"), volume_ratio_ema=Q.div("volume", Q.ema("volume", S.span(16), True)),
    volume_mom3=f"volume / nullif({Q.lag('volume', 3)}, 0) - 1", volume_roc10=f"(volume / nullif({Q.lag('volume', 10)}, 0) - 1) * 100",
    pvt=f"sum(coalesce(ret, 0) * volume) {Q.RUN}") + " FROM s")
def volume_indicators(spark, sf):
    df = I.add_pvt(I.add_volume(changed(spark, sf)))
    return out(df, "avg_volume_20", "avg_volume_24", "avg_volume_50", "volume_spike", "volume_ratio_ema", "volume_mom3", "volume_roc10", "pvt")


NR_SQL = "CASE WHEN high - low = ({m}) THEN 1 ELSE 0 END"


@query("gap_range_52w", f"WITH {Q.BARS}, {Q.numbered()} SELECT ticker, ts, " + sel(
    gap_pct="coalesce((open - pc) / nullif(pc, 0) * 100, 0)", nr4=NR_SQL.format(m=Q.full("min", "high - low", 4)),
    nr7=NR_SQL.format(m=Q.full("min", "high - low", 7)), high_52w=f"max(high) {Q.over(252)}", low_52w=f"min(low) {Q.over(252)}",
    pct_from_high=f"(close / max(high) {Q.over(252)} - 1) * 100", pct_from_low=f"(close / min(low) {Q.over(252)} - 1) * 100") + " FROM s")
def gap_range_52w(spark, sf):
    return out(I.add_gap_and_range(changed(spark, sf)), "gap_pct", "nr4", "nr7", "high_52w", "low_52w", "pct_from_high", "pct_from_low")


@query("momentum_roc", f"WITH {Q.BARS} SELECT ticker, ts, " + sel(
    **{f"roc_{k}": f"close / nullif({Q.lag('close', k)}, 0) - 1" for k in (1, 2, 4, 5, 6, 8, 10, 12, 20)},
    strength=f"((close / nullif({Q.lag('close', 5)}, 0) - 1) + (close / nullif({Q.lag('close', 10)}, 0) - 1)) / 2") + " FROM b")
def momentum_roc(spark, sf):
    return out(day(spark, sf), **{f"roc_{k}": I.roc(k) for k in (1, 2, 4, 5, 6, 8, 10, 12, 20)}, strength=(I.roc(5) + I.roc(10)) / 2)


@query("return_volatility", f"""WITH {Q.BARS}, {Q.numbered()}, v AS (SELECT *, {Q.std('ret', 16)} AS v16, {Q.std('ret', 20)} AS v20 FROM s),
 w AS (SELECT *, CASE WHEN high > lag(high) {Q.ROW} THEN 1 ELSE 0 END AS hh, CASE WHEN low < lag(low) {Q.ROW} THEN 1 ELSE 0 END AS ll,
 CASE WHEN low > lag(low) {Q.ROW} THEN 1 ELSE 0 END AS hl FROM v) SELECT ticker, ts, """ + sel(
    volatility="v16", vol_ratio=Q.div("v16", Q.mean("v16", 48)), annual="v20 * sqrt(252.0 * 26)",
    higher_highs=Q.full("sum", "hh", 4), lower_lows=Q.full("sum", "ll", 4), higher_lows=Q.full("sum", "hl", 4),
    trend_strength=f"(({Q.full('sum', 'hh', 4)}) - ({Q.full('sum', 'll', 4)})) / 4.0",
    extreme="CASE WHEN abs(ret) > 0.01 THEN 1 ELSE 0 END") + " FROM w")
def return_volatility(spark, sf):
    df = I.add_trend_counts(I.add_volatility(changed(spark, sf), 16, 48), 4)
    return out(df, "volatility", "vol_ratio", "higher_highs", "lower_lows", "higher_lows", "trend_strength",
               annual=I.realised_vol(S.std(c("ret"), 20)), extreme=I.extreme_move())


@query("percent_rank", f"""WITH {Q.BARS}, {Q.numbered()}, v AS (SELECT *, {Q.std('ret', 20)} AS vol FROM s),
 l AS (SELECT *, CASE WHEN count(vol) {Q.over(100)} = 100 THEN list(vol) {Q.over(100)} END AS a FROM v)
 SELECT ticker, ts, round((len(list_filter(a, lambda x: x < vol)) + (len(list_filter(a, lambda x: x = vol)) + 1) / 2.0) / 100, 4) AS rank_100 FROM l""")
def percent_rank(spark, sf):
    df = changed(spark, sf).withColumn("volatility", S.std(c("ret"), 20))
    return out(I.add_percent_rank(df, "volatility", 100, "rank_100"), "rank_100")


@query("cci", f"""WITH {Q.BARS}, {Q.numbered()}, v AS (SELECT *, (high + low + close) / 3 AS tp FROM s),
 l AS (SELECT *, {Q.mean('tp', 20)} AS m, list(tp) {Q.over(20)} AS a FROM v)
 SELECT ticker, ts, round((tp - m) / nullif(0.015 * list_sum(list_transform(a, lambda x: abs(x - m))) / 20, 0), 4) AS cci FROM l""")
def cci(spark, sf):
    return out(I.add_cci(day(spark, sf)), "cci")


_SUP, _RES = Q.full("min", "low", 20), Q.full("max", "high", 20)


@query("range_and_alignment", f"""WITH {Q.BARS}, v AS (SELECT *, {_SUP} AS sup, {_RES} AS res, {Q.mean('close', 5)} AS s5,
 {Q.mean('close', 10)} AS s10, {Q.mean('close', 20)} AS s20 FROM b) SELECT ticker, ts, """ + sel(
    support="sup", resistance="res", range_pos=Q.div("close - sup", "res - sup"), range_rel=Q.div("res - sup", "close"),
    close_pos=Q.div("close - low", "high - low"), spread=Q.div("high - low", "close"),
    trend_align="CASE WHEN s5 > s10 AND s10 > s20 THEN 1 WHEN s5 < s10 AND s10 < s20 THEN -1 ELSE 0 END",
    dist_sma20=Q.div("close - s20", "s20")) + " FROM v")
def range_and_alignment(spark, sf):
    df = I.add_trend_align(I.add_range_position(day(spark, sf)))
    return out(df, "support", "resistance", "range_pos", "range_rel", "close_pos", "spread", "trend_align", "dist_sma20")


@query("slope_divergence", f"""WITH {Q.BARS}, {Q.numbered()}, {OBV_SQL}, q AS (SELECT *,
 CASE WHEN r >= 4 THEN (-2 * lag(close, 4) {Q.ROW} - lag(close, 3) {Q.ROW} + lag(close) {Q.ROW} + 2 * close) / 10 END AS ps,
 CASE WHEN r >= 4 THEN (-2 * lag(obv, 4) {Q.ROW} - lag(obv, 3) {Q.ROW} + lag(obv) {Q.ROW} + 2 * obv) / 10 END AS os FROM o)
 SELECT ticker, ts, round(ps, 3) AS price_slope, round(os, 3) AS obv_slope, CASE WHEN os > 1e-6 AND ps < 0 THEN 'bullish'
 WHEN os < -1e-6 AND ps > 0 THEN 'bearish' ELSE 'none' END AS divergence FROM q""")
def slope_divergence(spark, sf):
    df = I.add_slopes(I.add_obv(changed(spark, sf)))
    df = df.withColumn("divergence", F.when((c("obv_slope") > 1e-6) & (c("price_slope") < 0), "bullish")
                       .when((c("obv_slope") < -1e-6) & (c("price_slope") > 0), "bearish").otherwise("none"))
    return S.unblock(df).select("ticker", "ts", r(c("price_slope"), 3).alias("price_slope"),
                                        r(c("obv_slope"), 3).alias("obv_slope"), "divergence")


TVM_SQL = """CASE WHEN hour(ts) + minute(ts) / 60.0 < 9.5 THEN {base} ELSE greatest({base} * (1 - 0.3 *
 sqrt(least(greatest(hour(ts) + minute(ts) / 60.0 - 9.5, 0), 6.5) / 6.5)), 1.1) END"""


@query("time_adjusted_volume", f"WITH {Q.BARS_15M} SELECT ticker, ts, round({TVM_SQL.format(base='1.5')}, 4) AS mult_15, "
       f"round({TVM_SQL.format(base='2.0')}, 4) AS mult_20 FROM b")
def time_adjusted_volume(spark, sf):
    return out(V.bars_15m(spark, sf), mult_15=I.time_adjusted_volume_mult(c("ts"), 1.5), mult_20=I.time_adjusted_volume_mult(c("ts"), 2.0))


@query("adaptive_threshold", f"WITH {Q.BARS}, {Q.numbered()}, q AS (SELECT *, {Q.TR} AS tr FROM s), z AS (SELECT *, {Q.mean('tr', 14)} AS a FROM q) "
       "SELECT ticker, ts, round(CASE WHEN a IS NULL OR close = 0 THEN 0.1 ELSE greatest(least(a / close * 100 * 0.002, 0.5), 0.05) END, 4) AS threshold, "
       "round(CASE WHEN a IS NOT NULL THEN greatest(high * 0.003, a * 0.1) ELSE high * 0.003 END, 4) AS buffer FROM z")
def adaptive_threshold(spark, sf):
    df = changed(spark, sf).withColumn("a", S.mean(c("tr"), 14))
    return out(df, threshold=F.when(c("a").isNull(), F.lit(0.1)).otherwise(I.adaptive_threshold(div(c("a"), c("close")) * 100, 0.002)),
               buffer=I.breakout_buffer(c("a"), c("high"), 0.003, 0.1))


# ------------------------------------------------------------------ bundles

REV_SQL = f"""CASE WHEN high <= lag(high) {Q.ROW} AND low >= lag(low) {Q.ROW} THEN 1 ELSE 0 END AS inside_bar,
 CASE WHEN least(open, close) - low > 2 * abs(close - open) AND high - greatest(open, close) < 0.5 * abs(close - open) THEN 1 ELSE 0 END AS hammer,
 CASE WHEN close > open AND lag(close) {Q.ROW} < lag(open) {Q.ROW} AND close > lag(open) {Q.ROW} AND open < lag(close) {Q.ROW} THEN 1
 WHEN close < open AND lag(close) {Q.ROW} > lag(open) {Q.ROW} AND close < lag(open) {Q.ROW} AND open > lag(close) {Q.ROW} THEN -1 ELSE 0 END AS engulfing"""


def daily_sql(src: str = "b", p: str = "") -> str:
    """CTEs of the daily bundle over src; the last one is {p}day."""
    return f"""{Q.numbered(src, p + 's')},
 {p}o AS (SELECT *, sum(coalesce(sign(d), 0) * volume) {Q.RUN} AS obv, {Q.TR} AS tr FROM {p}s),
 {p}e AS (SELECT *, {', '.join(f"avg(close) {Q.over(n)} AS sma_{n}" for n in (20, 50, 100, 200))},
 {', '.join(f"{Q.ema('close', S.span(n))} AS ema_{n}" for n in (20, 50, 100, 200))},
 {Q.ema(Q.GAIN, S.wilder(14))} AS wu, {Q.ema(Q.LOSS, S.wilder(14))} AS wv, {Q.ema('close', S.span(12))} - {Q.ema('close', S.span(26))} AS macd,
 {Q.ema('tr', S.wilder(14))} AS atr_14, {Q.mean('close', 20)} AS bb_mid, {Q.full('stddev_pop', 'close', 20)} AS bb_sd,
 avg(volume) {Q.over(20)} AS avg_volume_20, avg(volume) {Q.over(50)} AS avg_volume_50,
 coalesce((open - pc) / nullif(pc, 0) * 100, 0) AS gap_pct, high - low AS bar_range, max(high) {Q.over(252)} AS high_52w,
 min(low) {Q.over(252)} AS low_52w, {NR_SQL.format(m=Q.full('min', 'high - low', 4))} AS nr4,
 {NR_SQL.format(m=Q.full('min', 'high - low', 7))} AS nr7, {REV_SQL} FROM {p}o),
 {p}f AS (SELECT *, {Q.rsi('wu', 'wv')} AS rsi_14, {Q.ema('macd', S.span(9))} AS macd_signal, bb_mid + 2 * bb_sd AS bb_up,
 bb_mid - 2 * bb_sd AS bb_lo, (close - (bb_mid - 2 * bb_sd)) / nullif(4 * bb_sd, 0) AS bb_pos, volume / nullif(avg_volume_20, 0) AS volume_spike FROM {p}e),
 {p}day AS (SELECT *, rsi_14 - lag(rsi_14) {Q.ROW} AS rsi_slope, macd - macd_signal AS macd_hist,
 (close - high_52w) / nullif(high_52w, 0) * 100 AS pct_from_high, (close - low_52w) / nullif(low_52w, 0) * 100 AS pct_from_low FROM {p}f)"""


_DAILY = ["sma_20", "sma_50", "sma_100", "sma_200", "ema_20", "ema_50", "ema_100", "ema_200", "rsi_14", "rsi_slope", "macd",
          "macd_signal", "macd_hist", "atr_14", "bb_up", "bb_mid", "bb_lo", "bb_pos", "avg_volume_20", "avg_volume_50",
          "volume_spike", "obv", "gap_pct", "bar_range", "nr4", "nr7", "high_52w", "low_52w", "pct_from_high", "pct_from_low",
          "inside_bar", "hammer", "engulfing"]


@query("daily_bundle", f"WITH {Q.BARS}, {daily_sql()} SELECT ticker, ts, " + sel(**{k: k for k in _DAILY}) + " FROM day")
def daily_bundle(spark, sf):
    return out(I.daily_bundle(V.bars_1d(spark, sf)), *_DAILY)


HOURLY_SQL = f"""{Q.numbered()}, o AS (SELECT *, sum(coalesce(sign(d), 0) * volume) {Q.RUN} AS obv, avg(close) {Q.over(24)} AS sma_24,
 avg(close) {Q.over(168)} AS sma_168, {Q.ema('close', S.span(24))} AS ema_24, {Q.ema(Q.GAIN, S.wilder(14))} AS wu,
 {Q.ema(Q.LOSS, S.wilder(14))} AS wv, avg(volume) {Q.over(24)} AS avg_volume_24, coalesce((open - pc) / nullif(pc, 0) * 100, 0) AS gap_pct,
 {REV_SQL} FROM s), hr AS (SELECT *, {Q.rsi('wu', 'wv')} AS rsi_14, volume / nullif(avg_volume_24, 0) AS volume_spike FROM o)"""
_HOURLY = ["sma_24", "sma_168", "ema_24", "rsi_14", "avg_volume_24", "volume_spike", "gap_pct", "obv", "inside_bar", "hammer", "engulfing"]


@query("hourly_bundle", f"WITH {Q.BARS_1H}, {HOURLY_SQL} SELECT ticker, ts, " + sel(**{k: k for k in _HOURLY}) + " FROM hr")
def hourly_bundle(spark, sf):
    return out(I.hourly_bundle(V.bars_1h(spark, sf)), *_HOURLY)


_INTRA = ["opening_price", "running_hod", "running_lod", "or_high", "or_low", "session_vwap", "ema_9", "ema_20", "sma_5", "sma_20",
          "rsi_14", "rsi_slope", "atr_14", "bb_up", "bb_lo", "avg_volume_20", "volume_spike", "gap_pct", "nr4", "nr7", "obv",
          "inside_bar", "hammer", "engulfing"]
INTRA_SQL = f"""{SESSION_SQL.format(k=3)}, {Q.numbered('se')}, o AS (SELECT *, sum(coalesce(sign(d), 0) * volume) {Q.RUN} AS obv, {Q.TR} AS tr FROM s),
 e AS (SELECT *, {Q.ema('close', S.span(9))} AS ema_9, {Q.ema('close', S.span(20))} AS ema_20, {Q.mean('close', 5)} AS sma_5,
 {Q.mean('close', 20)} AS sma_20, {Q.ema(Q.GAIN, S.wilder(14))} AS wu, {Q.ema(Q.LOSS, S.wilder(14))} AS wv, {Q.ema('tr', S.wilder(14))} AS atr_14,
 {Q.full('stddev_pop', 'close', 20)} AS sd, {Q.mean('volume', 20)} AS avg_volume_20, (open - pc) / nullif(pc, 0) * 100 AS gap_pct,
 {NR_SQL.format(m=Q.full('min', 'high - low', 4))} AS nr4, {NR_SQL.format(m=Q.full('min', 'high - low', 7))} AS nr7, {REV_SQL} FROM o),
 f AS (SELECT *, {Q.rsi('wu', 'wv')} AS rsi_14, sma_20 + 2 * sd AS bb_up, sma_20 - 2 * sd AS bb_lo, volume / nullif(avg_volume_20, 0) AS volume_spike FROM e),
 it AS (SELECT *, rsi_14 - lag(rsi_14) {Q.ROW} AS rsi_slope FROM f)"""


@query("intraday_bundle", f"WITH {Q.BARS_15M}, {INTRA_SQL} SELECT ticker, ts, " + sel(**{k: k for k in _INTRA}) + " FROM it")
def intraday_bundle(spark, sf):
    return out(I.intraday_bundle(V.bars_15m(spark, sf)), *_INTRA)


VOLB_SQL = f"""{Q.numbered()}, vb0 AS (SELECT *, {Q.mean('volume', 20)} AS avg_volume, {Q.mean('volume', 5)} AS volume_sma_5,
 sum(coalesce(sign(d), 0) * volume) {Q.RUN} AS obv, (volume / nullif(lag(volume, 10) {Q.ROW}, 0) - 1) * 100 AS volume_roc,
 sum(coalesce(ret, 0) * volume) {Q.RUN} AS pvt,
 sum((high + low + close) / 3 * volume) {Q.RUN} / nullif(sum(volume) {Q.RUN}, 0) AS vwap_typical FROM s),
 vb AS (SELECT *, avg_volume AS volume_sma_20, volume / nullif(avg_volume, 0) AS volume_ratio, {Q.mean('obv', 10)} AS obv_sma FROM vb0)"""
_VOLB = ["avg_volume", "volume_ratio", "volume_sma_5", "volume_sma_20", "obv", "obv_sma", "volume_roc", "pvt", "vwap_typical"]


@query("volume_bundle", f"WITH {Q.BARS}, {VOLB_SQL} SELECT ticker, ts, " + sel(**{k: k for k in _VOLB}) + " FROM vb")
def volume_bundle(spark, sf):
    return out(I.volume_bundle(V.bars_1d(spark, sf)), *_VOLB)


@query("breakout_screen", f"""WITH {Q.BARS}, {daily_sql()}, l AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS k FROM day)
 SELECT ticker, ts, """ + sel(close="close", sma_50="sma_50", high_52w="high_52w", volume_spike="volume_spike", gap_pct="gap_pct")
       + ", CASE WHEN close >= high_52w AND volume_spike >= 1.5 THEN 1 ELSE 0 END AS breakout FROM l WHERE k = 1")
def breakout_screen(spark, sf):
    """Which tickers broke their 52-week high on volume on their latest bar?"""
    df = S.unblock(I.daily_bundle(V.bars_1d(spark, sf), obv=False))
    keep = ["close", "sma_50", "high_52w", "volume_spike", "gap_pct"]
    last = df.groupBy("ticker").agg(F.max_by(F.struct("ts", *keep), "ts").alias("x")).select("ticker", "x.*")
    return last.select("ticker", "ts", *[r(c(x)).alias(x) for x in keep],
                       F.when((c("close") >= c("high_52w")) & (c("volume_spike") >= 1.5), 1).otherwise(0).alias("breakout"))
