"""Nearest patterns, regimes, models, ensembles and sizes: queries and their SQL."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from barflow.functions.scalar import r
from barflow.operators import ensemble as E, indicators as I, knn as N, models as M, plugins as P, quantiles as U, regimes as G, scanners as C, series as S
from barflow.plans import sql as Q
from barflow.plans.indicator_queries import ADX_SQL, KELT_SQL, sel
from barflow.plans.registry import query
from barflow.sources import views as V

c = F.col
H3 = ("h1", "h3", "eod")


def _zs(arr, n):
    m = f"(list_sum({arr}) / {n})"
    return f"CASE WHEN sqrt(list_sum(list_transform({arr}, lambda x: (x - {m}) * (x - {m}))) / {n}) > 1e-12 THEN list_transform({arr}, lambda x: (x - {m}) / sqrt(list_sum(list_transform({arr}, lambda y: (y - {m}) * (y - {m}))) / {n})) END"


def _dist(n, w):
    ws = "[" + ", ".join(f"CAST({x!r} AS DOUBLE)" for x in w) + "]"
    return f"sqrt(list_sum(list_transform(range(1, {n + 1}), lambda i: {ws}[i] * (qs[i] - shape[i]) * (qs[i] - shape[i]))))"


def _cut_sql(n, p):
    return f"""{p}c AS (SELECT ticker, min(ts) AS cut FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS rn FROM b) WHERE rn <= {n} GROUP BY 1),
 {p}q0 AS (SELECT ticker, list(close ORDER BY ts) AS w, last(close ORDER BY ts) AS price FROM b JOIN {p}c USING (ticker) WHERE ts >= cut GROUP BY 1), {p}q AS (SELECT ticker, price, {_zs('w', n)} AS qs FROM {p}q0),
 {p}p AS (SELECT b.* FROM b JOIN {p}c USING (ticker) WHERE ts < cut)"""


def _session_sql(n, k, step, p, weights=None):
    o = "PARTITION BY ticker, CAST(ts AS DATE)"
    return f"""{_cut_sql(n, p)}, {p}s AS (SELECT *, row_number() OVER ({o} ORDER BY ts) - 1 AS no, count(*) OVER ({o}) AS n, list(close) OVER ({o} ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS w,
 lead(close, 4) OVER ({o} ORDER BY ts) AS x1, lead(close, 12) OVER ({o} ORDER BY ts) AS x3, last(close) OVER ({o} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS xe FROM {p}p),
 {p}l AS (SELECT ticker, ts, {_zs('w', n)} AS shape, x1 / close - 1 AS h1, x3 / close - 1 AS h3, xe / close - 1 AS eod FROM {p}s WHERE n >= {n + 4} AND no >= {n - 1} AND no - {n - 1} < n - {n} - CASE WHEN n >= {n + 12} THEN 12 ELSE 4 END AND (no - {n - 1}) % {step} = 0),
 {p}d AS (SELECT *, {_dist(n, weights or [1.0] * n)} AS dist FROM {p}l JOIN {p}q USING (ticker) WHERE shape IS NOT NULL), {p}z AS (SELECT ticker, count(*) AS library_size FROM {p}l WHERE shape IS NOT NULL GROUP BY 1),
 {p}k AS (SELECT * FROM {p}d QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY dist, ts) <= {k}),
 {p}f AS (SELECT ticker, any_value(price) AS price, {', '.join(f"sum({h} / (1 + dist)) / sum(1 / (1 + dist)) AS {h}" for h in H3)}, {', '.join(f"avg({h}) AS m_{h}" for h in H3)}, CASE WHEN count(*) > 1 THEN 1 / (1 + stddev_pop(dist)) ELSE 0.5 END AS cs FROM {p}k GROUP BY 1)"""


@query("knn_session_forecast", f"""WITH {Q.BARS_15M}, {_session_sql(20, 10, 1, 'ka', N.decay_weights(20))} SELECT ticker, {sel(digits=6, h1='h1', h3='h3', eod='eod')}, round(price, 4) AS price, round(cs, 4) AS confidence_score, library_size,
 CASE WHEN library_size > 10000 THEN 'HIGH' WHEN library_size > 1000 THEN 'MEDIUM' ELSE 'LOW' END || CASE WHEN cs > 0.8 THEN '+' WHEN cs < 0.3 THEN '-' ELSE '' END AS confidence FROM kaf JOIN kaz USING (ticker)""")
def knn_session_forecast(spark, sf):
    f = N.session_forecast(V.bars_15m(spark, sf), 20, 10)
    return f.select("ticker", *[r(c(h), 6).alias(h) for h in H3], r(c("price")).alias("price"), r(c("confidence_score")).alias("confidence_score"), "library_size", "confidence")


@query("knn_plain_forecast", f"WITH {Q.BARS_15M}, {_session_sql(12, 10, 1, 'ka')} SELECT ticker, {sel(digits=6, h1='m_h1', h3='m_h3', eod='m_eod')} FROM kaf")
def knn_plain_forecast(spark, sf):
    return N.plain_forecast(V.bars_15m(spark, sf), 12, 10).select("ticker", *[r(c(h), 6).alias(h) for h in H3])


@query("knn_multi_length", f"""WITH {Q.BARS_15M}, {_session_sql(8, 20, 1, 'ka', N.decay_weights(8))}, {_session_sql(12, 30, 1, 'kb', N.decay_weights(12))}, {_session_sql(20, 50, 1, 'kc', N.decay_weights(20))},
 u AS (SELECT ticker, h1, h3, eod, cs, 8 AS n, 0.4 AS w FROM kaf UNION ALL SELECT ticker, h1, h3, eod, cs, 12, 0.35 FROM kbf UNION ALL SELECT ticker, h1, h3, eod, cs, 20, 0.25 FROM kcf)
 SELECT ticker, {', '.join(f"round(coalesce(sum({h} * w) / nullif(sum(w) FILTER ({h} IS NOT NULL), 0), 0), 6) AS {h}" for h in H3)}, round(max(cs) FILTER (n = 20), 4) AS confidence_score FROM u GROUP BY 1""")
def knn_multi_length(spark, sf):
    f = N.multi_length_forecast(V.bars_15m(spark, sf))
    return f.select("ticker", *[r(c(h), 6).alias(h) for h in H3], r(c("confidence_score")).alias("confidence_score"))


_XW = N.exponential_weights(20)
CROSS_SQL = f"""{_cut_sql(20, 'x')}, xs AS (SELECT *, list(close) {Q.over(20, 1)} AS w, lag(ts) {Q.ROW} AS te, lead(close, 20) {Q.ROW} AS room, lead(close, 4) {Q.ROW} AS x1, lead(close, 12) {Q.ROW} AS x3, lead(close, 26) {Q.ROW} AS xe FROM b),
 xl AS (SELECT ticker, te AS ts, {_zs('w', 20)} AS shape, x1 / close - 1 AS h1, x3 / close - 1 AS h3, xe / close - 1 AS eod FROM xs WHERE len(w) = 20 AND room IS NOT NULL),
 xd AS (SELECT *, {_dist(20, _XW)} AS dist FROM xl JOIN xq USING (ticker) WHERE shape IS NOT NULL), xk AS (SELECT * FROM xd QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY dist, ts) <= 10),
 xf AS (SELECT ticker, avg(dist) AS ad, {', '.join(f"sum({h} / (dist + 1e-8)) / nullif(sum(1 / (dist + 1e-8)) FILTER ({h} IS NOT NULL), 0) AS {h}" for h in H3)} FROM xk GROUP BY 1),
 xz AS (SELECT ticker, count(*) AS library_size FROM xl WHERE shape IS NOT NULL GROUP BY 1)"""


@query("knn_cross_forecast", f"""WITH {Q.BARS}, {CROSS_SQL} SELECT ticker, {sel(digits=6, h1='h1', h3='h3', eod='eod')}, round(ad, 4) AS avg_distance, library_size, round(least(1.0, library_size / 100.0) / (1 + ad), 4) AS confidence,
 {', '.join(f"CASE WHEN {h} > thr THEN 'BUY' WHEN {h} < -thr THEN 'SELL' ELSE 'HOLD' END AS {h}_dir" for h in H3)} FROM xf JOIN xz USING (ticker)
 JOIN (SELECT ticker, CASE ticker WHEN '1' THEN 0.00075 WHEN '7' THEN 0.005 WHEN '50' THEN 0.002 WHEN '63' THEN 0.004 WHEN '88' THEN 0.00125 ELSE 0.0005 END AS thr FROM xz) th USING (ticker)""")
def knn_cross_forecast(spark, sf):
    f = N.cross_forecast(V.bars_1d(spark, sf), 20, 10, vol_mult={"1": 1.5, "7": 20.0, "50": 4.0, "63": 8.0, "88": 2.5}, interval_s=S.DAY)
    return f.select("ticker", *[r(c(h), 6).alias(h) for h in H3], r(c("avg_distance")).alias("avg_distance"), "library_size", r(c("confidence")).alias("confidence"), *[f"{h}_dir" for h in H3])


def _shape_sql(model):
    p = N.SHAPE_MODELS[model]
    n = p["n"]
    fast = model == "fast"
    strength = f"(CASE WHEN abs(sr) > {p['shape_min']} THEN sign(sr) * least(abs(sr) * {p['shape_gain']}, 1) * {p['shape_w']} ELSE 0 END + CASE WHEN abs(coalesce(mom, 0)) > {p['mom_min']} THEN sign(mom) * least(abs(mom) * {p['mom_gain']}, 1) * {p['mom_w']} ELSE 0 END"
    if fast:
        strength += " - CASE WHEN abs(ret) > 0.01 AND abs(p_ret) > 0.01 THEN sign(p_ret) * 2.0 ELSE 0 END) * CASE WHEN range_pct > 0.015 THEN 1.3 ELSE 1.0 END * CASE WHEN vr > 2 THEN 1.5 WHEN vr < 0.5 THEN 0.5 ELSE 1.0 END"
    else:
        strength += ") * CASE WHEN vr > 1.5 THEN 1.2 ELSE 1.0 END"
    return f"""{Q.numbered()}, r0 AS (SELECT *, {Q.std('ret', p['vol'])} AS vol, list(ret) {Q.over(n, 1)} AS rl, lag(ret) {Q.ROW} AS p_ret, close / nullif(lag(close, {p['mom']}) {Q.ROW}, 0) - 1 AS mom, volume / nullif({Q.mean('volume', p['vol'])}, 0) AS vr,
 lead(close, {p['ahead']}) {Q.ROW} / nullif(close, 0) - 1 AS future, (high - low) / nullif(close, 0) AS range_pct FROM s),
 r1 AS (SELECT *, list_transform(rl, lambda x: x / vol) AS shape, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS back FROM r0 WHERE vol > 0 AND len(list_filter(rl, lambda x: x IS NOT NULL)) = {n}),
 pr AS (SELECT q.ticker, q.ts AS att, q.shape AS qs, l.shape, l.future, l.ts FROM r1 q JOIN r1 l ON q.ticker = l.ticker AND q.back <= 26 AND l.back > 26 AND l.future IS NOT NULL), pd AS (SELECT *, {_dist(n, [1.0] * n)} AS dist FROM pr),
 pk AS (SELECT * FROM pd QUALIFY row_number() OVER (PARTITION BY ticker, att ORDER BY dist, ts) <= {p['k']}), px AS (SELECT ticker, att, sum(future / (dist + 0.1)) / sum(1 / (dist + 0.1)) AS sr FROM pk GROUP BY 1, 2),
 pz AS (SELECT r1.*, sr, {strength} AS strength FROM r1 JOIN px ON r1.ticker = px.ticker AND r1.ts = px.att),
 ps AS (SELECT ticker, ts, sr, strength, CASE WHEN abs(strength) >= {p['least']} AND row_number() OVER (PARTITION BY ticker, CAST(ts AS DATE) ORDER BY abs(strength) DESC, ts) <= {p['top']} THEN CAST(sign(strength) AS INTEGER) ELSE 0 END AS signal FROM pz)"""


@query("model_shape_steady", f"WITH {Q.BARS_15M}, {_shape_sql('steady')} SELECT ticker, ts, round(sr, 6) AS shape_return, round(strength, 4) AS strength, signal FROM ps")
def model_shape_steady(spark, sf):
    s = N.momentum_fallback(N.shape_signals(V.bars_15m(spark, sf), "steady"))
    return s.select("ticker", "ts", r(c("shape_return"), 6).alias("shape_return"), r(c("strength")).alias("strength"), "signal")


@query("model_shape_fast", f"WITH {Q.BARS_15M}, {_shape_sql('fast')} SELECT ticker, ts, round(sr, 6) AS shape_return, round(strength, 4) AS strength, signal FROM ps")
def model_shape_fast(spark, sf):
    s = N.shape_signals(V.bars_15m(spark, sf), "fast")
    return s.select("ticker", "ts", r(c("shape_return"), 6).alias("shape_return"), r(c("strength")).alias("strength"), "signal")


# ------------------------------------------------------------------ regimes

_LAGS = range(2, 60)
_LN = [math.log(k) for k in _LAGS]
_LN_MEAN = sum(_LN) / len(_LN)
HURST_SQL = f"""hq AS (SELECT *, list(close) {Q.over(120, 1)} AS hw FROM {{src}}),
 hh AS (SELECT *, CASE WHEN len(hw) = 120 AND list_aggregate(hw, 'stddev_pop') > 0 THEN 2 * list_sum(list_transform(range(2, 60), lambda k: (ln(k) - {_LN_MEAN!r}) * ln(greatest(list_aggregate(list_transform(range(1, 121 - k), lambda i: hw[i + k] - hw[i]), 'stddev_pop'), 1e-300)) / 2))
 / {sum((x - _LN_MEAN) ** 2 for x in _LN)!r} ELSE 0.5 END AS hurst FROM hq)"""


def _flag_z(x):
    return f"coalesce(CASE WHEN count({x}) {Q.over(60)} >= 20 THEN ({x} - avg({x}) {Q.over(60)}) / (stddev_samp({x}) {Q.over(60)} + 1e-10) END, 0)"


def _regime_sql(adx="25", hurst="0.45", keltner="0.2", src="hh"):
    """rz: the bars with the composite score and its label; thresholds may be columns of ``src``."""
    return f"""rf AS (SELECT *, CASE WHEN adx > {adx} THEN 1.0 ELSE 0.0 END AS fa, CASE WHEN hurst < {hurst} THEN 0.0 ELSE 1.0 END AS fh, CASE WHEN keltner_pct > {keltner} THEN 1.0 ELSE 0.0 END AS fk FROM {src}),
 ry AS (SELECT *, tanh((0.4 * {_flag_z('fa')} + 0.4 * {_flag_z('fh')} + 0.2 * {_flag_z('fk')}) / 3) AS score FROM rf), rz AS (SELECT *, CASE WHEN score > 0.3 THEN 'trending' WHEN score < -0.3 THEN 'ranging' ELSE 'uncertain' END AS label FROM ry)"""


@query("hurst", f"WITH {Q.BARS}, {HURST_SQL.format(src='b')} SELECT ticker, ts, round(hurst, 4) AS hurst FROM hh")
def hurst(spark, sf):
    return S.unblock(I.add_hurst(S.blocked(V.bars_1d(spark, sf)))).select("ticker", "ts", r(c("hurst")).alias("hurst"))


@query("regime_composite", f"""WITH {Q.BARS}, {Q.numbered()}, {ADX_SQL}, {KELT_SQL.format(src='ax')}, {HURST_SQL.format(src='kk')}, {_regime_sql()}
 SELECT label AS regime_label, count(*) AS bars, round(avg(score), 4) AS score, round(avg(adx), 4) AS adx FROM rz GROUP BY 1""")
def regime_composite(spark, sf):
    df = S.unblock(G.add_regime(S.blocked(V.bars_1d(spark, sf))))
    return df.groupBy("regime_label").agg(F.count(F.lit(1)).alias("bars"), r(F.avg("regime_score")).alias("score"), r(F.avg("adx")).alias("adx"))


REG_SQL = f"{Q.numbered()}, {ADX_SQL}, rg AS (SELECT *, tanh((adx - 25) / 20) AS regime_score FROM ax)"
_PW = """CASE profile WHEN 'NVDA' THEN 0.5 + 0.45 * greatest(regime_score, 0) WHEN 'AAPL' THEN 0.3 * greatest(regime_score, 0) WHEN 'MSFT' THEN CASE WHEN regime_score > 0.5 THEN 0.4 + 0.3 * (regime_score - 0.5) ELSE 0.1 END
 ELSE CASE WHEN regime_score > 0.3 THEN 0.6 + 0.35 * (regime_score - 0.3) / 0.7 WHEN regime_score < -0.3 THEN 0.1 ELSE 0.3 END END"""
_PROF = "CASE CAST(ticker AS INTEGER) % 4 WHEN 0 THEN 'NVDA' WHEN 1 THEN 'TSLA' WHEN 2 THEN 'AAPL' ELSE 'MSFT' END AS profile"


def _profile():
    k = c("ticker").cast("int") % 4
    return F.when(k == 0, "NVDA").when(k == 1, "TSLA").when(k == 2, "AAPL").otherwise("MSFT")


def _scored(spark, sf):
    df = I.add_adx(I.add_change(S.blocked(V.bars_1d(spark, sf))))
    return df.withColumns({"regime_score": F.tanh((c("adx") - 25) / 20), "profile": _profile()})


@query("regime_weights", f"""WITH {Q.BARS}, {REG_SQL}, z AS (SELECT *, {_PROF}, median(regime_score) {Q.over(3)} AS smooth_3, median(regime_score) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS centered_3 FROM rg)
 SELECT ticker, ts, round(regime_score, 4) AS score, round(smooth_3, 4) AS smooth_3, round(centered_3, 4) AS centered_3, round(greatest(0, least(1, 0.5 + 0.5 * regime_score)), 4) AS linear, round({_PW}, 4) AS by_profile,
 CASE WHEN regime_score > 0.3 THEN 'trending' WHEN regime_score < -0.3 THEN 'ranging' ELSE 'uncertain' END AS label FROM z""")
def regime_weights(spark, sf):
    df = _scored(spark, sf)
    df = df.withColumns({"smooth_3": G.smooth(c("regime_score"), 3), "centered_3": G.smooth(c("regime_score"), 3, True)})
    s = c("regime_score")
    return S.unblock(df).select("ticker", "ts", r(s).alias("score"), r(c("smooth_3")).alias("smooth_3"), r(c("centered_3")).alias("centered_3"),
                                r(G.linear_weight(s)).alias("linear"), r(G.profile_weight(c("profile"), s)).alias("by_profile"), G.label(s).alias("label"))


_TER = f"""{Q.numbered()}, v0 AS (SELECT *, {Q.std('ret', 120)} * sqrt(252.0 * 26) AS vol FROM s), v1 AS (SELECT * FROM v0 WHERE vol IS NOT NULL),
 vc AS (SELECT ticker, quantile_cont(vol, 0.33) AS lo, quantile_cont(vol, 0.67) AS hi FROM v1 GROUP BY 1), vt AS (SELECT v1.*, lo, hi, CASE WHEN vol <= lo THEN 0 WHEN vol <= hi THEN 1 ELSE 2 END AS regime FROM v1 JOIN vc USING (ticker))"""


@query("regime_volatility_terciles", f"WITH {Q.BARS}, {_TER} SELECT ticker, ts, round(vol, 4) AS vol, round(lo, 4) AS low_cut, round(hi, 4) AS high_cut, regime FROM vt")
def regime_volatility_terciles(spark, sf):
    df = G.volatility_terciles(V.bars_1d(spark, sf), 120, S.DAY)
    return df.select("ticker", "ts", *[r(c(x)).alias(x) for x in ("vol", "low_cut", "high_cut")], "regime")


@query("exact_quantiles", """SELECT event_type AS ticker, round(quantile_cont(value, 0.33), 4) AS q33, round(median(value), 4) AS mid, round(quantile_cont(value, 0.67), 4) AS q67 FROM events GROUP BY 1""")
def exact_quantiles(spark, sf):
    e = V.table(spark, sf, "events").withColumn("ticker", c("event_type"))
    q = U.exact_quantiles(e, ["ticker"], "value", {"q33": 0.33, "mid": 0.5, "q67": 0.67})
    return q.select("ticker", *[r(c(x)).alias(x) for x in ("q33", "mid", "q67")])


_RF = f"""{Q.numbered()}, f0 AS (SELECT *, (max(high) {Q.over(26)} - min(low) {Q.over(26)}) / nullif(close, 0) AS rng, lag(close, 260) {Q.ROW} AS first, lag(close) {Q.ROW} AS lastc, stddev_samp(ret) {Q.over(259, 1)} AS vv, avg(volume) {Q.over(260, 1)} AS v1, avg(volume) {Q.over(2340, 1)} AS v90 FROM s),
 f1 AS (SELECT *, vv * sqrt(252.0 * 26) AS realised_vol, abs(lastc / first - 1) AS trend, ({' + '.join(f'lag(rng, {1 + 26 * k}) {Q.ROW}' for k in range(10))}) / 10 AS day_range, least(abs(month(ts) - 2), abs(month(ts) - 5), abs(month(ts) - 8), abs(month(ts) - 11)) * 30 AS gap,
 CAST(make_date(year(ts), month(ts), 15) AS TIMESTAMP) + to_days(CAST((5 - dayofweek(make_date(year(ts), month(ts), 15)) + 7) % 7 AS INTEGER)) AS fri FROM f0)"""


@query("regime_features", f"""WITH {Q.BARS}, {_RF} SELECT ticker, ts, {sel(realised_vol='realised_vol', trend_strength='trend', volume_regime='CASE WHEN r >= 2340 THEN v1 / nullif(v90, 0) ELSE 1.0 END', day_range='day_range', earnings_proximity='exp(-gap / 45.0)',
    expiry_proximity="exp(-abs(floor(epoch(ts - fri) / 86400.0)) / 7.0)")} FROM f1 WHERE r >= 260""")
def regime_features(spark, sf):
    df = G.regime_features(V.bars_1d(spark, sf), 10, 26, S.DAY)
    return df.select("ticker", "ts", *[r(c(x)).alias(x) for x in ("realised_vol", "trend_strength", "volume_regime", "day_range", "earnings_proximity", "expiry_proximity")])


@query("regime_clusters")
def regime_clusters(spark, sf):
    f = G.regime_features(V.bars_15m(spark, sf), 10, 26).na.fill(0.0, G.FEATURES)
    return G.cluster_summary(G.cluster(f))


_RK = f"""{_TER}, cur AS (SELECT ticker, arg_max(regime, ts) AS cr FROM vt GROUP BY 1), {_cut_sql(20, 'x')}, xs AS (SELECT *, list(close) {Q.over(20, 1)} AS w, lag(close) {Q.ROW} AS base, lead(close, 4) {Q.ROW} AS x1, lead(close, 12) {Q.ROW} AS x3,
 last(close) OVER ({Q.PART} ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING) AS xe FROM b),
 xl AS (SELECT xs.ticker, xs.ts, {_zs('w', 20)} AS shape, x1 / base - 1 AS h1, x3 / base - 1 AS h3, xe / base - 1 AS eod, vt.regime, cr FROM xs JOIN vt ON vt.ticker = xs.ticker AND vt.ts = xs.ts JOIN cur ON cur.ticker = xs.ticker WHERE len(w) = 20 AND x3 IS NOT NULL),
 xd AS (SELECT *, {_dist(20, [1.0] * 20)} / CASE WHEN regime = cr THEN 1.0 ELSE 1.0 - 0.7 END AS dist, CASE WHEN regime = cr THEN 1.0 ELSE 1.0 - 0.7 END AS sim FROM xl JOIN xq USING (ticker) WHERE shape IS NOT NULL),
 xk AS (SELECT *, sim / (1 + dist) AS w FROM xd QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY dist, ts) <= 10)"""


@query("regime_weighted_forecast", f"""WITH {Q.BARS}, {_RK} SELECT ticker, {', '.join(f"round(coalesce(sum({h} * w) / nullif(sum(w) FILTER ({h} IS NOT NULL), 0), 0), 6) AS {h}" for h in H3)}, any_value(cr) AS current_regime,
 round(avg(CASE WHEN regime = cr THEN 1 ELSE 0 END), 4) AS match_ratio, round(least(1.0, avg(CASE WHEN regime = cr THEN 1 ELSE 0 END) + 0.3), 4) AS confidence FROM xk GROUP BY 1""")
def regime_weighted_forecast(spark, sf):
    bars = V.bars_1d(spark, sf)
    ter = G.volatility_terciles(bars, 120, S.DAY).select("ticker", "ts", "regime")
    current = ter.groupBy("ticker").agg(F.max_by("regime", "ts").alias("current_regime"))
    lib = N.regime_library(bars, ter, interval_s=S.DAY)
    f = N.regime_forecast(lib, N.current_shape(N.last_bars(bars, 20), 20).join(current, "ticker"), 10, times=bars, interval_s=S.DAY)
    return f.select("ticker", *[r(c(h), 6).alias(h) for h in H3], "current_regime", r(c("match_ratio")).alias("match_ratio"), r(c("confidence")).alias("confidence"))


# ------------------------------------------------------------------ models

_RSIW = f"{Q.ema(Q.GAIN, S.wilder(14))} AS u, {Q.ema(Q.LOSS, S.wilder(14))} AS v"
_BASE = f"""{Q.numbered()}, a0 AS (SELECT *, {_RSIW}, {Q.mean('close', 5)} AS s5, {Q.mean('close', 10)} AS s10, {Q.mean('close', 20)} AS s20, {Q.mean('close', 50)} AS s50, {Q.full('stddev_pop', 'close', 20)} AS sd, {Q.std('ret', 20)} AS vol,
 volume / nullif({Q.mean('volume', 20)}, 0) AS vr, volume / nullif({Q.mean('volume', 50)}, 0) AS vr50, lag(ret) {Q.ROW} AS p_ret, (high + low + close) / 3 AS tp, {Q.full('min', 'low', 20)} AS sup, {Q.full('max', 'high', 20)} AS res,
 (close - low) / nullif(high - low, 0) AS cpos, (high - low) / nullif(close, 0) AS spread FROM s),
 a1 AS (SELECT *, {Q.rsi('u', 'v')} AS rsi, CASE WHEN s5 > s10 AND s10 > s20 THEN 1 WHEN s5 < s10 AND s10 < s20 THEN -1 ELSE 0 END AS ta, (close - s20) / nullif(s20, 0) AS d20, (close - s50) / nullif(s50, 0) AS d50, {Q.mean('vol', 50)} AS vma,
 CASE WHEN count(vol) {Q.over(100)} = 100 THEN list(vol) {Q.over(100)} END AS vl, {Q.mean('tp', 20)} AS tpm, list(tp) {Q.over(20)} AS tl, lag(cpos) {Q.ROW} AS p_cpos, max(vol) {Q.over(5, 1)} AS rv, avg(vol) {Q.over(45, 6)} AS av, (close - sup) / nullif(res - sup, 0) AS rp, (res - sup) / nullif(close, 0) AS rrel FROM a0),
 a2 AS (SELECT *, (len(list_filter(vl, lambda x: x < vol)) + (len(list_filter(vl, lambda x: x = vol)) + 1) / 2.0) / 100 AS vp, (tp - tpm) / nullif(0.015 * list_sum(list_transform(tl, lambda x: abs(x - tpm))) / 20, 0) AS cci FROM a1)"""
_ONE = "CASE WHEN sum(abs({x})) OVER (PARTITION BY ticker, {p} ORDER BY ts) <= {n} THEN {x} ELSE 0 END"
_PAT = f"""{_BASE}, b0 AS (SELECT *, CASE WHEN NOT (r >= 100 AND d20 IS NOT NULL AND rsi IS NOT NULL AND vp IS NOT NULL) OR coalesce(vol > vma * 1.5, false) THEN 0
 WHEN abs(d20) > 0.02 THEN CASE WHEN vp < 0.7 AND hour(ts) IN (0, 14, 15, 20) THEN CASE WHEN d20 > 0.02 AND rsi > 65 AND ta <= 0 THEN -1 WHEN d20 < -0.02 AND rsi < 35 AND ta >= 0 THEN 1 ELSE 0 END ELSE 0 END
 WHEN vr > 1.5 THEN CASE WHEN abs(p_ret) > 0.005 THEN CASE WHEN close > s20 + 2 * sd AND rsi > 70 THEN -1 WHEN close < s20 - 2 * sd AND rsi < 30 THEN 1 ELSE 0 END ELSE 0 END
 WHEN 4 * sd / nullif(s20, 0) < 0.01 THEN CASE WHEN close > s20 + 2 * sd THEN -1 WHEN close < s20 - 2 * sd THEN 1 ELSE 0 END ELSE 0 END AS raw,
 CASE WHEN abs(d20) > 0.02 THEN least(abs(d20) * 50, 1.0) WHEN vr > 1.5 THEN 0.7 ELSE 0.5 END AS conf FROM a2)"""


@query("model_patient_reversion", f"WITH {Q.BARS}, {_PAT} SELECT ticker, ts, {_ONE.format(x='raw', p='CAST(ts AS DATE)', n=1)} AS signal, round(CASE WHEN raw <> 0 THEN conf ELSE 0 END, 4) AS confidence FROM b0")
def model_patient_reversion(spark, sf):
    return M.patient_reversion(V.bars_1d(spark, sf), S.DAY, hours=(0, 14, 15, 20)).select("ticker", "ts", "signal", r(c("confidence")).alias("confidence"))


def _cnt(*conds):
    return "(" + " + ".join(f"CASE WHEN {x} THEN 1 ELSE 0 END" for x in conds) + ")"


_OV = _cnt("rsi > 55", "cci > 100", "close > s20 + 2 * sd", "rp > 0.9", "spread < 0.5") .replace("rsi > 55", "rsi > 70")
_UN = _cnt("rsi < 30", "cci < -100", "close < s20 - 2 * sd", "rp < 0.1", "spread < 0.5")
_EXT = f"""{_BASE}, b0 AS (SELECT *, CASE WHEN abs(d20) > 0.02 THEN CASE WHEN (d20 > 0 AND d50 > 0) OR (d20 < 0 AND d50 < 0) THEN CASE WHEN d20 > 0.02 AND {_OV} >= 4 THEN -1 WHEN d20 < -0.02 AND {_UN} >= 4 THEN 1 ELSE 0 END ELSE 0 END
 WHEN close > s20 + 3 * sd OR close < s20 - 3 * sd THEN CASE WHEN vp > 0.5 THEN CASE WHEN close > s20 + 3 * sd AND rsi > 75 AND vr50 < 1.5 THEN -1 WHEN close < s20 - 3 * sd AND rsi < 25 AND vr50 < 1.5 THEN 1 ELSE 0 END ELSE 0 END
 WHEN rrel > 0.03 THEN CASE WHEN rp > 0.95 AND p_cpos < 0.9 AND vr50 > 1.5 AND rsi > 65 THEN -1 WHEN rp < 0.05 AND p_cpos > 0.1 AND vr50 > 1.5 AND rsi < 35 THEN 1 ELSE 0 END ELSE 0 END AS raw,
 CASE WHEN abs(d20) > 0.02 THEN least(abs(d20) * 40 + CASE WHEN d20 > 0 THEN {_OV} ELSE {_UN} END * 0.1, 1.0) WHEN close > s20 + 3 * sd OR close < s20 - 3 * sd THEN 0.8 ELSE 0.6 END AS conf FROM a2),
 b1 AS (SELECT *, CASE WHEN r >= 100 AND d20 IS NOT NULL AND rsi IS NOT NULL AND cci IS NOT NULL AND raw <> 0 THEN conf ELSE 0 END AS cf FROM b0), b2 AS (SELECT *, CASE WHEN cf >= 0.7 AND NOT coalesce(rv > av * 2, false) THEN raw ELSE 0 END AS s0 FROM b1),
 b3 AS (SELECT *, {_ONE.format(x='s0', p='CAST(ts AS DATE)', n=1)} AS s1 FROM b2)"""


@query("model_extreme_reversion", f"WITH {Q.BARS}, {_EXT} SELECT ticker, ts, {_ONE.format(x='s1', p=chr(100) + 'ate_trunc(' + chr(39) + 'week' + chr(39) + ', ts)', n=3)} AS signal, round(cf, 4) AS confidence FROM b3")
def model_extreme_reversion(spark, sf):
    return M.extreme_reversion(V.bars_1d(spark, sf), S.DAY, spread_max=0.5).select("ticker", "ts", "signal", r(c("confidence")).alias("confidence"))


@query("model_training_stats", f"""WITH {Q.BARS}, {_BASE}, f AS (SELECT *, lead(close, 4) {Q.ROW} / nullif(close, 0) - 1 AS fut FROM a2), t AS (SELECT unnest([0.01, 0.015, 0.02, 0.025])::DOUBLE AS threshold)
 SELECT ticker, threshold, count(*) AS cases, round(avg(fut), 4) AS avg_return, round(avg(CASE WHEN fut < 0 THEN 1 ELSE 0 END), 4) AS win_rate FROM f, t WHERE fut IS NOT NULL AND d20 > threshold GROUP BY 1, 2""")
def model_training_stats(spark, sf):
    return M.reversion_stats(V.bars_1d(spark, sf)).withColumns({"avg_return": r(c("avg_return")), "win_rate": r(c("win_rate"))})


@query("model_extreme_stats", f"""WITH {Q.BARS}, {_BASE}, f AS (SELECT *, lead(close, 4) {Q.ROW} / nullif(close, 0) - 1 AS fut FROM a2)
 SELECT ticker, count(*) AS samples, round(avg(CASE WHEN abs(fut) > 0.002 THEN 1 ELSE 0 END), 4) AS profitable FROM f WHERE r >= 100 AND fut IS NOT NULL AND abs(d20) > 0.015 GROUP BY 1""")
def model_extreme_stats(spark, sf):
    return M.extreme_stats(V.bars_1d(spark, sf)).withColumn("profitable", r(c("profitable")))


_SIGS = f"{REG_SQL}, g0 AS (SELECT *, CASE WHEN close / nullif(lag(close, 5) {Q.ROW}, 0) - 1 > 0.03 THEN 1 WHEN close / nullif(lag(close, 5) {Q.ROW}, 0) - 1 < -0.03 THEN -1 ELSE 0 END AS ms, {Q.mean(Q.GAIN, 14)} AS gu, {Q.mean(Q.LOSS, 14)} AS gv, {Q.mean('tr', 14)} AS atr FROM rg), g1 AS (SELECT *, {Q.rsi('gu', 'gv')} AS rsi FROM g0), g2 AS (SELECT *, CASE WHEN rsi < 40 THEN 1 WHEN rsi > 60 THEN -1 ELSE 0 END AS tsg, {_PROF}, CASE WHEN regime_score > 0.3 THEN 'trending' WHEN regime_score < -0.3 THEN 'ranging' ELSE 'uncertain' END AS rl FROM g1)"


def _signals(spark, sf):
    """Two simple models (5-bar momentum, RSI side) with a regime score, on daily bars."""
    df = I.add_rsi_sma(_scored(spark, sf), 14)
    df = df.withColumns({"momentum_signal": F.when(I.roc(5) > 0.03, 1).when(I.roc(5) < -0.03, -1).otherwise(0),
                         "technical_signal": F.when(c("rsi") < 40, 1).when(c("rsi") > 60, -1).otherwise(0),
                         "regime_label": G.label(c("regime_score")), "atr": S.mean(c("tr"), 14)})
    return I.add_rolling_vwap(df).withColumn("vwap", c("vwap_roll"))


@query("model_latest_signals", f"""WITH {Q.BARS}, {_SIGS}, n AS (SELECT *, count(*) OVER (PARTITION BY ticker) AS total FROM g2) SELECT ticker, ts, ms AS signal, round(close, 4) AS close FROM n WHERE r >= floor(total * 0.8) AND ms <> 0
 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) <= 5""")
def model_latest_signals(spark, sf):
    df = _signals(spark, sf).withColumn("signal", c("momentum_signal"))
    return M.latest_signals(df).select("ticker", "ts", "signal", r(c("close")).alias("close"))


_VF = f"""{Q.numbered()}, w0 AS (SELECT *, stddev_samp(ret) {Q.over(39, 20)} AS tv, avg(ret) {Q.over(19)} AS mom, stddev_samp(ret) {Q.over(19)} AS cv, {Q.mean('close', 8)} AS m8, {Q.mean('close', 32)} AS m32 FROM s), wl AS (SELECT * FROM w0 WHERE r >= 59 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) = 1)"""


@query("forecast_volatility", f"WITH {Q.BARS}, {_VF} SELECT ticker, ts, {sel(digits=6, training_vol='tv', momentum='mom', current_vol='cv', confidence='0.8 * least(tv, cv) / nullif(greatest(tv, cv), 0)')} FROM wl")
def forecast_volatility(spark, sf):
    return M.volatility_forecast(V.bars_1d(spark, sf), S.DAY).select("ticker", "ts", *[r(c(x), 6).alias(x) for x in ("training_vol", "momentum", "current_vol", "confidence")])


_BIAS = "(m8 - m32) / nullif(m32, 0) * 100"
_HROWS = " UNION ALL ".join(f"SELECT ticker, ts, close, '{h}' AS horizon, {_BIAS} * {k} * 0.01 AS pct, {_BIAS} * 0.02 AS top FROM wl" for h, k in (("h1", 1.0), ("h3", 1.5), ("eod", 2.0)))


@query("forecast_rows", f"""WITH {Q.BARS}, {_VF}, u AS ({_HROWS}) SELECT ticker, ts, horizon, round(pct, 4) AS pct, round(close * (1 + pct / 100), 4) AS price, CASE WHEN pct > 0.1 THEN 'BULLISH' WHEN pct < -0.1 THEN 'BEARISH' ELSE 'NEUTRAL' END AS direction,
 CASE WHEN abs(top) > 0.5 THEN 'HIGH' WHEN abs(top) > 0.2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM u""")
def forecast_rows(spark, sf):
    f = M.forecast_rows(M.momentum_bias(V.bars_1d(spark, sf), S.DAY, 0.01), 0.1)
    return f.select("ticker", "ts", "horizon", r(c("pct")).alias("pct"), r(c("price")).alias("price"), "direction", "confidence")


@query("forecast_vote", f"""WITH {Q.BARS}, {_VF}, u AS ({_HROWS}), d AS (SELECT *, CASE WHEN pct > 0.1 THEN 'BULLISH' WHEN pct < -0.1 THEN 'BEARISH' ELSE 'NEUTRAL' END AS direction, least(abs(pct), 1.0) AS score FROM u),
 g AS (SELECT ticker, count(*) FILTER (direction = 'BULLISH') AS bullish, count(*) FILTER (direction = 'BEARISH') AS bearish, coalesce(avg(score) FILTER (score > 0.6), 0.3) AS oc FROM d GROUP BY 1)
 SELECT ticker, bullish, bearish, round(oc, 4) AS overall_confidence, CASE WHEN bullish > bearish THEN 'BUY' WHEN bearish > bullish THEN 'SELL' ELSE 'HOLD' END AS recommendation FROM g""")
def forecast_vote(spark, sf):
    f = M.forecast_rows(M.momentum_bias(V.bars_1d(spark, sf), S.DAY, 0.01), 0.1).withColumn("score", F.least(F.abs("pct"), F.lit(1.0)))
    return M.horizon_vote(f).withColumn("overall_confidence", r(c("overall_confidence")))


@query("forecast_blend", f"""WITH {Q.BARS}, {_VF}, y AS (SELECT ticker, 0.8 * least(tv, cv) / nullif(greatest(tv, cv), 0) AS cb, mom AS vb, {_BIAS} / 100 AS ba FROM wl)
 SELECT ticker, {', '.join(f"round(0.6 / (0.6 + cb) * ba * {k} + (1 - 0.6 / (0.6 + cb)) * vb, 6) AS {h}" for h, k in (("h1", 1.0), ("h3", 1.5), ("eod", 2.0)))}, 0.6::DOUBLE AS confidence FROM y""")
def forecast_blend(spark, sf):
    bars = V.bars_1d(spark, sf)
    a = M.momentum_bias(bars, S.DAY, 0.01).withColumn("confidence", F.lit(0.6))
    b = M.volatility_forecast(bars, S.DAY)
    b = b.select("ticker", "confidence", *[c("momentum").alias(h) for h in H3])
    return M.blend(a, b).select("ticker", *[r(c(h), 6).alias(h) for h in H3], "confidence")


# ------------------------------------------------------------------ ensembles

_P = "(VALUES " + ", ".join("('%s', %s)" % (p[0], ", ".join(f"{x}" for x in p[1:])) for p in E.PROFILES) + ") AS p(profile, version, adx_min, hurst_max, keltner_min, smoothing, full_, half, quarter, min_conf, long_at, short_at, strength, max_daily, stop_mult, trail_r, min_size)"
_PROBS = "CASE WHEN version = 1 THEN 0.5 + 0.4 * {x} ELSE 1 / (1 + exp(-CAST(strength AS DOUBLE) * {x})) END"
_A1 = """CASE WHEN ms = tsg AND ms <> 0 THEN [ms, full_] WHEN ms <> 0 AND tsg <> 0 THEN CASE rl WHEN 'trending' THEN [ms, half] WHEN 'ranging' THEN [tsg, half] ELSE [es, quarter] END
 WHEN ms <> 0 THEN CASE rl WHEN 'trending' THEN [ms, half] WHEN 'uncertain' THEN [ms, quarter] ELSE [0, 0] END WHEN tsg <> 0 THEN CASE rl WHEN 'ranging' THEN [tsg, half] WHEN 'uncertain' THEN [tsg, quarter] ELSE [0, 0] END
 ELSE CASE WHEN abs(ep - 0.5) > 0.2 THEN [es, quarter] ELSE [0, 0] END END"""
_A2 = """CASE WHEN ms = tsg AND ms <> 0 THEN CASE WHEN abs(mp - 0.5) > 0.25 AND abs(tpb - 0.5) > 0.25 THEN [ms, full_] ELSE [ms, half] END WHEN ms <> 0 AND tsg <> 0 THEN CASE WHEN cf >= min_conf AND rl = 'trending' THEN [ms, quarter] WHEN cf >= min_conf AND rl = 'ranging' THEN [tsg, quarter] ELSE [0, 0] END
 WHEN ms <> 0 THEN CASE WHEN rl = 'trending' AND abs(mp - 0.5) > 0.3 THEN [ms, half] WHEN rl = 'uncertain' AND cf >= min_conf THEN [ms, quarter] ELSE [0, 0] END
 WHEN tsg <> 0 THEN CASE WHEN rl = 'ranging' AND abs(tpb - 0.5) > 0.3 THEN [tsg, half] WHEN rl = 'uncertain' AND cf >= min_conf THEN [tsg, quarter] ELSE [0, 0] END ELSE CASE WHEN cf >= min_conf * 1.2 THEN [es, quarter] ELSE [0, 0] END END"""
ENS_SQL = f"""{_SIGS}, h0 AS (SELECT g2.*, p.* EXCLUDE (profile), {_PROBS.format(x='ms')} AS mp, {_PROBS.format(x='tsg')} AS tpb FROM g2 JOIN {_P} ON g2.profile = p.profile),
 h1 AS (SELECT *, CASE WHEN version = 1 THEN greatest(0, least(1, 0.5 + 0.5 * regime_score)) ELSE {_PW} END AS wmo FROM h0), h2 AS (SELECT *, wmo * mp + (1 - wmo) * tpb AS ep FROM h1),
 h3 AS (SELECT *, abs(ep - 0.5) * 2 AS cf, CASE WHEN ep >= long_at THEN 1 WHEN ep <= short_at THEN -1 ELSE 0 END AS es FROM h2), h4 AS (SELECT *, CASE WHEN version = 1 THEN {_A1} ELSE {_A2} END AS ar FROM h3),
 h5 AS (SELECT *, CAST(ar[1] AS INTEGER) AS sg, CAST(ar[2] AS DOUBLE) AS sz FROM h4), h6 AS (SELECT *, CASE WHEN coalesce(sum(CASE WHEN sg <> 0 AND sz > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker, CAST(ts AS DATE) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < max_daily THEN 1 ELSE 0 END AS keep FROM h5),
 en AS (SELECT * REPLACE (CASE WHEN keep = 1 THEN sg ELSE 0 END AS sg, CASE WHEN keep = 1 THEN sz ELSE 0 END AS sz) FROM h6)"""


def _ensemble(spark, sf):
    return E.combine(_signals(spark, sf), E.profiles(spark))


@query("ensemble_signals", f"""WITH {Q.BARS}, {ENS_SQL} SELECT ticker, ts, profile, sg AS signal, {sel(size='sz', ensemble_prob='ep', w_momentum='wmo', stop_price='CASE WHEN sg <> 0 AND sz > 0 THEN close - sg * stop_mult * coalesce(atr, close * 0.01) ELSE 0 END',
    trailing_stop='CASE WHEN sg <> 0 AND sz > 0 THEN close + sg * trail_r * coalesce(atr, close * 0.01) ELSE 0 END')} FROM en""")
def ensemble_signals(spark, sf):
    df = E.stop_levels(E.cap_daily(S.unblock(_ensemble(spark, sf))))
    return df.select("ticker", "ts", "profile", "signal", *[r(c(x)).alias(x) for x in ("size", "ensemble_prob", "w_momentum", "stop_price", "trailing_stop")])


_MODEL_PROFILE = "CASE ticker WHEN 'click' THEN 'NVDA' WHEN 'view' THEN 'TSLA' WHEN 'error' THEN 'MSFT' ELSE 'AAPL' END"
_SMOOTH = " ".join(f"WHEN {n} THEN median(score) {Q.over(n)}" for n in (2, 3, 10, 15))
MODELS_SQL = f"""{_shape_sql('steady')}, fb AS (SELECT ticker, ts, CASE WHEN max(abs(signal)) OVER (PARTITION BY ticker) = 0 AND no >= 12 AND no % 13 = 0 AND abs(mom) > 0.002 THEN CAST(sign(mom) AS INTEGER) ELSE signal END AS ms
 FROM (SELECT ps.*, pz.mom, row_number() OVER (PARTITION BY ps.ticker ORDER BY ps.ts) - 1 AS no FROM ps JOIN pz USING (ticker, ts))), {_PAT.replace(Q.numbered() + ', ', '', 1)}, tm AS (SELECT ticker, ts, {_ONE.format(x='raw', p='CAST(ts AS DATE)', n=1)} AS tsg FROM b0),
 {ADX_SQL}, {KELT_SQL.format(src='ax')}, {HURST_SQL.format(src='kk')}, hp AS (SELECT hh.*, {_MODEL_PROFILE} AS profile FROM hh), hs AS (SELECT hp.*, p.adx_min, p.hurst_max, p.keltner_min, p.smoothing FROM hp JOIN {_P} ON hp.profile = p.profile),
 {_regime_sql('CAST(adx_min AS DOUBLE)', 'CAST(hurst_max AS DOUBLE)', 'CAST(keltner_min AS DOUBLE)', 'hs')}, g1 AS (SELECT *, CASE smoothing {_SMOOTH} END AS regime_score, {Q.mean('tr', 14)} AS atr FROM rz),
 g2 AS (SELECT g1.ticker, g1.ts, g1.close, g1.profile, g1.label AS rl, g1.regime_score, g1.atr, fb.ms, tm.tsg FROM g1 JOIN fb USING (ticker, ts) JOIN tm USING (ticker, ts)), {ENS_SQL[len(_SIGS) + 2:]}"""


@query("ensemble_models", f"""WITH {Q.BARS_15M}, {MODELS_SQL} SELECT ticker, ts, profile, rl AS regime_label, ms AS momentum_signal, tsg AS technical_signal, sg AS signal, {sel(regime_score='regime_score', size='sz', ensemble_prob='ep', w_momentum='wmo',
    stop_price='CASE WHEN sg <> 0 AND sz > 0 THEN close - sg * stop_mult * coalesce(atr, close * 0.01) ELSE 0 END')} FROM en""")
def ensemble_models(spark, sf):
    """The momentum-and-shape and the patient reversion model on 15-minute bars, every setting of the profiles in use."""
    t = c("ticker")
    profile = F.when(t == "click", "NVDA").when(t == "view", "TSLA").when(t == "error", "MSFT").otherwise("AAPL")
    df = P.ensemble(V.bars_15m(spark, sf), lambda b: N.momentum_fallback(N.shape_signals(b, "steady")), lambda b: M.patient_reversion(b, hours=(0, 14, 15, 20)),
                    E.profiles(spark), profile)
    return df.select("ticker", "ts", "profile", "regime_label", "momentum_signal", "technical_signal", "signal",
                     *[r(c(x)).alias(x) for x in ("regime_score", "size", "ensemble_prob", "w_momentum", "stop_price")])


_VZ = f"(volume - {Q.mean('volume', 50)}) / nullif({Q.std('volume', 50)}, 0) > 3"
_FLT = f"""f0 AS (SELECT *, {Q.std('ret', 20)} AS vol FROM en), f1 AS (SELECT *, CASE WHEN vol > ({Q.mean('vol', 20)}) * 1.5 THEN 1 ELSE 0 END AS vh, CASE WHEN {_VZ} THEN 1 ELSE 0 END AS vs FROM f0),
 f2 AS (SELECT *, sz * CASE WHEN profile = 'NVDA' AND vh = 1 THEN 0.8 WHEN profile = 'TSLA' AND vs = 1 THEN 0.7 ELSE 1.0 END AS z FROM f1)"""


@query("ensemble_size_filters", f"WITH {Q.BARS}, {ENS_SQL}, {_FLT} SELECT ticker, ts, CASE WHEN z < min_size THEN 0 ELSE sg END AS signal, round(CASE WHEN z < min_size THEN 0 ELSE z END, 4) AS size FROM f2")
def ensemble_size_filters(spark, sf):
    df = _ensemble(spark, sf).withColumns({"vol": S.std(c("ret"), 20), "_vm": S.mean(c("volume"), 50), "_vd": S.std(c("volume"), 50)})
    df = df.withColumns({"vol_high": F.when(c("vol") > S.mean(c("vol"), 20) * 1.5, 1).otherwise(0),
                         "volume_spike": F.when(F.try_divide(c("volume") - c("_vm"), c("_vd")) > 3, 1).otherwise(0)})
    return E.size_filters(E.cap_daily(S.unblock(df))).select("ticker", "ts", "signal", r(c("size")).alias("size"))


_LAB = ("trending", "ranging", "uncertain")


@query("ensemble_attribution", f"""WITH {Q.BARS}, {ENS_SQL} SELECT profile, round(avg(CASE WHEN ms = tsg THEN 1 ELSE 0 END), 4) AS agreement, {', '.join(f"round(avg(CASE WHEN rl = '{x}' THEN 1 ELSE 0 END), 4) AS share_{x}, round(avg(wmo) FILTER (rl = '{x}'), 4) AS w_{x}" for x in _LAB)},
 round(avg(CASE WHEN wmo > 0.6 THEN 1 ELSE 0 END) FILTER (ep <> 0.5), 4) AS momentum_driven, round(avg(CASE WHEN 1 - wmo > 0.6 THEN 1 ELSE 0 END) FILTER (ep <> 0.5), 4) AS technical_driven, round(avg(cf), 4) AS avg_confidence, round(avg(CASE WHEN cf > min_conf THEN 1 ELSE 0 END), 4) AS high_confidence FROM en GROUP BY 1""")
def ensemble_attribution(spark, sf):
    a = E.attribution(S.unblock(_ensemble(spark, sf)))
    return a.select("profile", *[r(c(x)).alias(x) for x in a.columns if x != "profile"])


_BANDS = f"""bd0 AS (SELECT *, sum(close * volume) {Q.over(20)} / sum(volume) {Q.over(20)} AS vw0, CASE WHEN r >= 19 THEN sum(close * volume) {Q.over(20)} / sum(volume) {Q.over(20)} END AS vwap, volume / nullif(avg(volume) {Q.over(25, 1)}, 0) AS vr FROM en),
 bd1 AS (SELECT *, CASE WHEN sg <> 0 AND atr IS NOT NULL AND vwap IS NOT NULL THEN least(close, vwap) - 0.1 * atr END AS lo, CASE WHEN sg <> 0 AND atr IS NOT NULL AND vwap IS NOT NULL THEN greatest(close, vwap) + 0.1 * atr END AS hi FROM bd0),
 bd AS (SELECT *, CASE WHEN sg > 0 THEN lo - 0.5 * atr WHEN sg < 0 THEN hi + 0.5 * atr END AS sl, {', '.join(f"CASE WHEN sg > 0 THEN hi + {k} * atr WHEN sg < 0 THEN lo - {k} * atr END AS t{h}" for h, k in (("1h", 0.5), ("3h", 1.0), ("eod", 1.5)))} FROM bd1)"""


def _cards(spark, sf):
    df = _ensemble(spark, sf).withColumns({"volume_ratio": F.try_divide(c("volume"), F.avg("volume").over(S.w(25, 1))), "keltner_pct": F.lit(0.0)})
    df = df.withColumn("vwap", F.when(c(S.POS) >= 19, c("vwap")))
    df = E.cap_daily(S.unblock(df)).filter(c("vwap").isNotNull() & c("atr").isNotNull())
    return E.entry_bands(df)


@query("ensemble_cards", f"""WITH {Q.BARS}, {ENS_SQL}, {_BANDS} SELECT ticker, ts, CASE WHEN sg > 0 THEN 'BUY' WHEN sg < 0 THEN 'SELL' ELSE 'NEUTRAL' END AS signal_type, CASE WHEN sg = 0 THEN 'None' WHEN sz >= 1 THEN 'Strong Agreement' WHEN sz >= 0.5 THEN 'Moderate Agreement' WHEN sz > 0 THEN 'Weak Agreement' ELSE 'Conflict' END AS model_agreement,
 {sel(volume_ratio='vr', entry_low='lo', entry_high='hi', stop_loss='sl', target_1h='t1h', target_eod='teod', rr_3h='abs(t3h - hi) / nullif(abs(sl - hi), 0)')}, ts + INTERVAL '45 minutes' AS expires_at FROM bd WHERE vwap IS NOT NULL AND atr IS NOT NULL""")
def ensemble_cards(spark, sf):
    k = E.signal_cards(_cards(spark, sf))
    return k.select("ticker", "ts", "signal_type", "model_agreement", r(c("volume_ratio")).alias("volume_ratio"), *[r(c(f"entry_bands.{x}")).alias(x) for x in (
        "entry_low", "entry_high", "stop_loss", "target_1h", "target_eod")], r(c("risk_reward.h3")).alias("rr_3h"), "expires_at")


@query("ensemble_percent_bands", f"""WITH {Q.BARS}, {ENS_SQL} SELECT ticker, ts, {sel(entry_low='close * 0.999', entry_high='close * 1.001', stop_loss='close - sg * close * 0.02', target_1h='close + sg * close * 0.03 * 0.33', target_eod='close + sg * close * 0.03')} FROM en WHERE sg <> 0""")
def ensemble_percent_bands(spark, sf):
    df = E.percent_bands(E.cap_daily(S.unblock(_ensemble(spark, sf)))).filter(c("signal") != 0)
    return df.select("ticker", "ts", *[r(c(x)).alias(x) for x in ("entry_low", "entry_high", "stop_loss", "target_1h", "target_eod")])


@query("ensemble_actionable", f"""WITH {Q.BARS}, {ENS_SQL}, {_BANDS}, a AS (SELECT * FROM bd WHERE vwap IS NOT NULL AND atr IS NOT NULL AND sg <> 0), k AS (SELECT count(*) AS total, count(*) FILTER (sg > 0) AS buys, count(*) FILTER (sg < 0) AS sells, count(*) FILTER (sz >= 0.5) AS high_confidence FROM a),
 t AS (SELECT * FROM a ORDER BY sz DESC, ts, ticker LIMIT 3) SELECT ticker, ts, CASE WHEN sg > 0 THEN 'BUY' ELSE 'SELL' END AS signal_type, round(sz, 4) AS confidence, total, buys, sells, high_confidence FROM t, k""")
def ensemble_actionable(spark, sf):
    counts, top = E.actionable(E.signal_cards(_cards(spark, sf)))
    return top.crossJoin(F.broadcast(counts)).select("ticker", "ts", "signal_type", r(c("confidence")).alias("confidence"), "total", "buys", "sells", "high_confidence")


@query("ensemble_active_table", f"""WITH {Q.BARS}, {ENS_SQL}, {_BANDS} SELECT rl AS regime, CASE WHEN sg > 0 THEN 'BUY' ELSE 'SELL' END AS signal_type, count(*) AS n FROM bd WHERE vwap IS NOT NULL AND atr IS NOT NULL AND sg <> 0 AND sz >= 0.7 GROUP BY 1, 2""")
def ensemble_active_table(spark, sf):
    return E.active_table(E.signal_cards(_cards(spark, sf))).groupBy("regime", "signal_type").agg(F.count(F.lit(1)).alias("n"))


_FX = "CASE WHEN floor(floor(2000 / nullif(rps, 0)) * sz) * ep0 > 25000 THEN floor(25000 / nullif(ep0, 0)) ELSE floor(floor(2000 / nullif(rps, 0)) * sz) END"
SIZE_SQL = f"""{_BANDS}, z0 AS (SELECT *, (lo + hi) / 2 AS ep0, abs((lo + hi) / 2 - sl) AS rps FROM bd WHERE vwap IS NOT NULL AND atr IS NOT NULL AND sg <> 0), z1 AS (SELECT *, CAST({_FX} AS BIGINT) AS fs, CAST(floor(100000 * greatest(0.0, least(0.25, (0.5 * sz * 1.5 - (1 - 0.5 * sz)) / 1.5 * 0.25)) / nullif(ep0, 0)) AS BIGINT) AS ks,
 CAST(floor(100000 * (greatest(0.05, least(0.25, 0.25 * (1 - atr / nullif(ep0, 0) * 10))) * sz) / nullif(ep0, 0)) AS BIGINT) AS vs0 FROM z0), z2 AS (SELECT *, CASE WHEN sz >= 0.7 THEN CASE WHEN ks > fs THEN 'kelly_criterion' ELSE 'fixed_risk' END WHEN sz >= 0.5 THEN CASE WHEN least(fs, ks, vs0) = fs THEN 'fixed_risk' WHEN least(fs, ks, vs0) = ks THEN 'kelly_criterion' ELSE 'volatility_adjusted' END ELSE 'volatility_adjusted' END AS method FROM z1),
 sz_ AS (SELECT *, CASE method WHEN 'kelly_criterion' THEN ks WHEN 'fixed_risk' THEN fs ELSE vs0 END AS shares FROM z2)"""


@query("position_sizes", f"WITH {Q.BARS}, {ENS_SQL}, {SIZE_SQL} SELECT ticker, ts, fs AS fixed_shares, ks AS kelly_shares, vs0 AS volatility_shares, shares, method, {sel(position_value='shares * ep0', risk_amount='shares * rps')} FROM sz_")
def position_sizes(spark, sf):
    df = E.position_sizes(_cards(spark, sf).withColumn("confidence", c("size"))).filter(c("signal") != 0)
    return df.select("ticker", "ts", "fixed_shares", "kelly_shares", "volatility_shares", "shares", "method", r(c("position_value")).alias("position_value"), r(c("risk_amount")).alias("risk_amount"))


@query("position_portfolio", f"WITH {Q.BARS}, {ENS_SQL}, {SIZE_SQL} SELECT ticker, count(shares) AS positions, round(sum(shares * ep0), 4) AS allocated, round(sum(shares * rps), 4) AS risk, round(sum(shares * ep0) / 1000, 4) AS allocated_pct, round(sum(shares * rps) / 1000, 4) AS risk_pct FROM sz_ GROUP BY 1")
def position_portfolio(spark, sf):
    df = E.position_sizes(_cards(spark, sf).withColumn("confidence", c("size"))).filter(c("signal") != 0)
    p = E.portfolio(df)
    return p.select("ticker", "positions", *[r(c(x)).alias(x) for x in ("allocated", "risk", "allocated_pct", "risk_pct")])
