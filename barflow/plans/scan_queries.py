"""Scanners and score models: queries and their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from barflow.functions.scalar import r
from barflow.operators import candles as K, joins as J, scanners as C, series as S
from barflow.plans import sql as Q
from barflow.plans.indicator_queries import sel
from barflow.plans.registry import query
from barflow.plans.rule_queries import CANDLE_EVENTS_SQL, CANDLE_SQL
from barflow.sources import views as V

c = F.col


def feature_sql(profile: str) -> str:
    """CTEs of a profile over s; the last one is fx."""
    p = C.PROFILES[profile]
    f, s_, g = p["macd"]
    adj = p["macd_adjust"]
    up, dn = (Q.mean(Q.GAIN, p["rsi"]), Q.mean(Q.LOSS, p["rsi"])) if p["rsi_kind"] == "sma" else \
        (Q.ema(Q.GAIN, S.wilder(p["rsi"])), Q.ema(Q.LOSS, S.wilder(p["rsi"])))
    atr = Q.mean("tr", p["atr"]) if p["atr_kind"] == "sma" else Q.ema("tr", S.span(p["atr"]))
    return f"""{Q.numbered()}, f0 AS (SELECT *, {Q.TR} AS tr, CASE WHEN high > lag(high) {Q.ROW} THEN 1 ELSE 0 END AS hh0, CASE WHEN low < lag(low) {Q.ROW} THEN 1 ELSE 0 END AS ll0,
 CASE WHEN low > lag(low) {Q.ROW} THEN 1 ELSE 0 END AS hl0 FROM s),
 f1 AS (SELECT *, {Q.mean('close', p['fast'])} AS sma_fast, {Q.mean('close', p['slow'])} AS sma_slow, {Q.ema('close', S.span(p['fast']), True)} AS ema_fast,
 {Q.ema('close', S.span(p['slow']), True)} AS ema_slow, {up} AS u, {dn} AS v, {Q.full('min', 'low', p['k'])} AS klo, {Q.full('max', 'high', p['k'])} AS khi,
 {Q.mean('close', p['bb'])} AS bm, {Q.std('close', p['bb'])} AS bs, volume / nullif({Q.mean('volume', p['vol'])}, 0) AS volume_ratio,
 volume / nullif({Q.ema('volume', S.span(p['vol']), True)}, 0) AS volume_ratio_ema, {atr} AS atr, {Q.ema('close', S.span(f), adj)} - {Q.ema('close', S.span(s_), adj)} AS macd,
 (close / nullif(lag(close, {p['roc']}) {Q.ROW}, 0) - 1) * 100 AS roc, close / nullif(lag(close, 6) {Q.ROW}, 0) - 1 AS price_mom, {Q.std('ret', p['volat'][0])} AS volat,
 volume / nullif(lag(volume, 3) {Q.ROW}, 0) - 1 AS volume_mom, {Q.full('sum', 'hh0', p['trend'])} AS hh, {Q.full('sum', 'll0', p['trend'])} AS ll, {Q.full('sum', 'hl0', p['trend'])} AS hl,
 (close / nullif(lag(close, 10) {Q.ROW}, 0) - 1) * 100 AS roc10, {Q.full('min', 'low', 20)} AS sup, {Q.full('max', 'high', 20)} AS res FROM f0),
 f2 AS (SELECT *, {Q.rsi('u', 'v')} AS rsi, 100 * (close - klo) / nullif(khi - klo, 0) AS k, bm + {p['bb_k']} * bs AS bu, bm - {p['bb_k']} * bs AS bl,
 {Q.ema('macd', S.span(g), adj)} AS msig, volat / nullif({Q.mean('volat', p['volat'][1])}, 0) AS vol_ratio, (hh - ll) / {float(p['trend'])} AS trend_strength,
 lag(sma_fast) {Q.ROW} AS psf, lag(sma_slow) {Q.ROW} AS pss, lag(ema_fast) {Q.ROW} AS pef, lag(ema_slow) {Q.ROW} AS pes, macd - lag(macd, 2) {Q.ROW} AS macd_mom,
 CASE WHEN count(volat) {Q.over(100)} = 100 THEN list(volat) {Q.over(100)} END AS vl FROM f1),
 f3 AS (SELECT *, {Q.mean('k', p['d'])} AS kd, (bu - bl) / nullif(bm, 0) AS bw, (close - bl) / nullif(bu - bl, 0) AS bp, (close - bm) / nullif(bs, 0) AS bz, macd - msig AS hist,
 rsi - lag(rsi, 3) {Q.ROW} AS rsi_mom, {Q.mean('rsi', 5)} AS rsi_ma, {Q.mean('roc', 5)} AS roc_mean,
 (len(list_filter(vl, lambda x: x < volat)) + (len(list_filter(vl, lambda x: x = volat)) + 1) / 2.0) / 100 AS vol_rank FROM f2),
 fx AS (SELECT *, lag(hist) {Q.ROW} AS ph, avg(vol_ratio) {Q.over(10)} AS cv, avg(trend_strength) {Q.over(8)} AS ct FROM f3)"""


def cs(*pairs, default="0.0"):
    return "(CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {default} END)"


def cross(f, s_, pf, ps, fresh, held):
    return cs((f"{f} > {s_} AND {pf} <= {ps}", fresh), (f"{f} < {s_} AND {pf} >= {ps}", -fresh), (f"{f} > {s_}", held), (f"{f} < {s_}", -held))


def scan(spark, sf, profile):
    return C.features(S.blocked(V.bars_1d(spark, sf)), profile)


_BASIC = {
    "ma_cross": cross("sma_fast", "sma_slow", "psf", "pss", 2.0, 1.0), "rsi": cs(("rsi < os", 1.0), ("rsi > ob", -1.0)),
    "stoch": cs(("k < 20 AND k > kd + 1e-9", 1.0), ("k > 80 AND k < kd - 1e-9", -1.0)), "bb": cs(("close <= bl", 1.0), ("close >= bu", -1.0)),
    "macd": cs(("hist > 0 AND ph <= 0", 1.0), ("hist < 0 AND ph >= 0", -1.0)), "volume": cs(("volume_ratio > 1.5", 1.0), ("volume_ratio < 0.5", -1.0)),
    "momentum": cs(("roc > 1", 1.0), ("roc < -1", -1.0)),
}


def _sum(parts, w):
    return " + ".join(f"c_{k} * {w[k]}" for k in w)


def _comp(parts):
    return ", ".join(f"CAST({v} AS DOUBLE) AS c_{k}" for k, v in parts.items())


_VRB = f"coalesce(atr / nullif(avg(atr) {Q.RUN}, 0), 1.0)"


@query("scan_basic", f"""WITH {Q.BARS}, {feature_sql('basic')}, v AS (SELECT *, {_VRB} AS vr FROM fx),
 t AS (SELECT *, {cs(('vr > 1.5', 35), ('vr < 0.7', 25), default='30')} AS os, {cs(('vr > 1.5', 65), ('vr < 0.7', 75), default='70')} AS ob FROM v),
 q AS (SELECT *, {_comp(_BASIC)} FROM t), z AS (SELECT *, {_sum(_BASIC, C.WEIGHTS['basic'])} AS score FROM q)
 SELECT ticker, ts, round(score, 4) AS score, CASE WHEN score >= 4 THEN 'BUY' WHEN score <= -4 THEN 'SELL' ELSE 'HOLD' END AS signal,
 round(CASE WHEN abs(score) >= 4 THEN least(abs(score) / 17.0, 0.95) ELSE 0.5 - abs(score) / 34.0 END, 4) AS confidence, round(vr, 4) AS volatility_ratio,
 round(CASE WHEN score >= 4 THEN close - 2 * atr WHEN score <= -4 THEN close + 2 * atr END, 4) AS stop_loss,
 round(CASE WHEN score >= 4 THEN close + 3 * atr WHEN score <= -4 THEN close - 3 * atr END, 4) AS take_profit FROM z""")
def scan_basic(spark, sf):
    df = S.unblock(C.basic_scan(scan(spark, sf, "basic")))
    return df.select("ticker", "ts", r(c("score")).alias("score"), "signal", *[r(c(x)).alias(x) for x in (
        "confidence", "volatility_ratio", "stop_loss", "take_profit")])


_OPT = {
    "ma_cross": f"greatest({cross('sma_fast', 'sma_slow', 'psf', 'pss', 2.5, 1.0)}, {cross('ema_fast', 'ema_slow', 'pef', 'pes', 2.5, 1.0)})",
    "rsi": cs(("rsi < os - 10", 2.0), ("rsi < os", 1.0), ("rsi > ob + 10", -2.0), ("rsi > ob", -1.0)) + " + 0.5 * " + cs(("rsi_mom > 2", 1.0), ("rsi_mom < -2", -1.0)),
    "stoch": cs(("k IS NULL OR kd IS NULL", 0.0), ("k < 25 AND k > kd + 1e-9", 1.5), ("k > 75 AND k < kd - 1e-9", -1.5), ("k < 15", 1.0), ("k > 85", -1.0)),
    "bb": cs(("bp <= 0.05 AND bw > 0.03", 2.0), ("bp <= 0.05", 1.0), ("bp >= 0.95 AND bw > 0.03", -2.0), ("bp >= 0.95", -1.0)),
    "macd": cs(("hist > 0 AND ph <= 0", 1.5), ("hist < 0 AND ph >= 0", -1.5), ("hist > 0 AND ph IS NOT NULL", 0.5), ("hist < 0 AND ph IS NOT NULL", -0.5))
    + " + 0.3 * " + cs(("macd_mom > 0.001", 1.0), ("macd_mom < -0.001", -1.0)),
    "volume": cs(("volume_ratio_ema > 1.8", 1.5), ("volume_ratio_ema > 1.3", 1.0), ("volume_ratio_ema < 0.4", -0.5)) + " + " + cs(("volume_mom > 0.3", 0.5), ("volume_mom < -0.3", -0.5)),
    "momentum": cs(("roc > 2", 1.5), ("roc > 0.8", 0.8), ("roc < -2", -1.5), ("roc < -0.8", -0.8)) + " + " + cs(("price_mom > 0.015", 0.5), ("price_mom < -0.015", -0.5)),
    "volatility": cs(("cv > 1.6 AND atr / nullif(close, 0) > 0.025", 0.8), ("cv > 1.6", 0.4), ("cv < 0.6", -0.3)),
}
_SHIFT = f"{cs(('cv > 1.4', 8), ('cv > 1.1', 4), ('cv < 0.8', -6))} + {cs(('ct > 0.4', -3), ('ct < -0.4', 3))} + CASE WHEN bw IS NOT NULL THEN greatest(-8, least(8, (bw - 0.02) * 200)) END"
OPT_SQL = f"""{feature_sql('optimized')}, t0 AS (SELECT *, {_SHIFT} AS shift, {cs(('cv > 1.3', 0.85), ('cv < 0.7', 1.15), default='1.0')} AS mult FROM fx),
 t AS (SELECT *, CASE WHEN shift IS NOT NULL THEN greatest(15, least(45, 32 + shift)) END AS os, CASE WHEN shift IS NOT NULL THEN greatest(55, least(85, 68 - shift)) END AS ob FROM t0),
 q AS (SELECT *, {_comp(_OPT)} FROM t), z0 AS (SELECT *, ({_sum(_OPT, C.WEIGHTS['optimized'])}) * mult AS score FROM q),
 z AS (SELECT *, CASE WHEN score >= 5.2 THEN 'BUY' WHEN score <= -5.2 THEN 'SELL' ELSE 'HOLD' END AS signal,
 CASE WHEN abs(score) >= 5.2 THEN least(abs(score) / (11.8 * 1.5), 0.98) ELSE greatest(0.1, 0.6 - abs(score) / 23.6) END AS confidence,
 CASE WHEN vol_ratio IS NOT NULL THEN greatest(1.5, least(3, vol_ratio)) END AS vm FROM z0)"""


@query("scan_optimized", f"""WITH {Q.BARS}, {OPT_SQL} SELECT ticker, ts, {sel(score='score', confidence='confidence', oversold='os', overbought='ob',
    **{f'c_{k}': f'c_{k}' for k in _OPT})}, signal, CASE WHEN signal = 'HOLD' THEN 'Neutral' WHEN confidence >= 0.85 THEN 'Very Strong' WHEN confidence >= 0.7 THEN 'Strong'
 WHEN confidence >= 0.55 THEN 'Moderate' ELSE 'Weak' END AS strength, {sel(stop_loss="CASE signal WHEN 'BUY' THEN close - 2.2 * atr * vm WHEN 'SELL' THEN close + 2.2 * atr * vm END",
    take_profit="CASE signal WHEN 'BUY' THEN close + 3.8 * atr * vm WHEN 'SELL' THEN close - 3.8 * atr * vm END")}, ts + INTERVAL '15 minutes' AS expires_at FROM z""")
def scan_optimized(spark, sf):
    df = S.unblock(C.optimized_scan(scan(spark, sf, "optimized")))
    num = {x: c(x) for x in ("score", "confidence", "oversold", "overbought", "stop_loss", "take_profit")}
    num.update({f"c_{k}": c(f"components.{k}") for k in _OPT})
    return df.select("ticker", "ts", *[r(v).alias(k) for k, v in num.items()], "signal", "strength", "expires_at")


@query("scan_summary", f"""WITH {Q.BARS}, {OPT_SQL}, l AS (SELECT * FROM z ORDER BY ts DESC, ticker LIMIT 200) SELECT count(*) AS total, count(*) FILTER (signal = 'BUY') AS buy,
 count(*) FILTER (signal = 'SELL') AS sell, count(*) FILTER (signal = 'HOLD') AS hold, round(avg(confidence), 4) AS avg_confidence, count(*) FILTER (confidence >= 0.7) AS high,
 count(*) FILTER (confidence >= 0.5 AND confidence < 0.7) AS medium, count(*) FILTER (confidence < 0.5) AS low FROM l""")
def scan_summary(spark, sf):
    log = S.unblock(C.optimized_scan(scan(spark, sf, "optimized"))).select("ticker", "ts", "signal", "confidence")
    return C.signal_summary(log, 200).withColumn("avg_confidence", r(c("avg_confidence")))


@query("model_balanced", f"WITH {Q.BARS}, {OPT_SQL} SELECT ticker, ts, CASE WHEN r >= 83 AND score >= 5.2 THEN 1 WHEN r >= 83 AND score <= -5.2 THEN -1 ELSE 0 END AS signal FROM z")
def model_balanced(spark, sf):
    return S.unblock(C.balanced_model(S.blocked(V.bars_1d(spark, sf)))).select("ticker", "ts", c("model_signal").alias("signal"))


_W = C.WEIGHTS["momentum"]
MOM_SQL = f"""{feature_sql('momentum')}, m1 AS (SELECT *, {cs(('pef IS NULL', 0.0), ('ema_fast > ema_slow AND pef <= pes', 3.0), ('ema_fast < ema_slow AND pef >= pes', -3.0), ('ema_fast > ema_slow', 1.5), default='-1.5')} * {_W['ma_cross']}
 + {cs(('rsi < 25 AND rsi_mom > 0', 1.5), ('rsi > 75 AND rsi_mom < 0', -1.5), ('rsi > 40 AND rsi < 60 AND rsi_mom > 1', 0.5))} * {_W['rsi']}
 + {cs(('k > kd + 1e-9 AND k < 30', 1.0), ('k < kd - 1e-9 AND k > 70', -1.0))} * {_W['stoch']} + {cs(('bp > 1', 1.5), ('bp < 0', -1.5), ('bw < 0.02 AND bp > 0.4 AND bp < 0.6', 0.5))} * {_W['bb']}
 + {cs(('hist > 0 AND ph <= 0', 2.0), ('hist < 0 AND ph >= 0', -2.0), ('macd_mom > 0.001', 1.0), ('macd_mom < -0.001', -1.0))} * {_W['macd']} AS s1, (roc + roc10) / 2 AS mom, (hh + hl) / 10.0 AS tsc FROM fx),
 m2 AS (SELECT *, CASE WHEN volume_ratio > 1.5 AND s1 > 0 THEN s1 + 1.5 * {_W['volume']} WHEN volume_ratio < 0.5 THEN s1 * 0.7 ELSE s1 END AS s2 FROM m1),
 mm AS (SELECT *, s2 + {cs(('mom > 3', 2.5), ('mom > 1.5', 1.5), ('mom < -3', -2.5), ('mom < -1.5', -1.5))} * {_W['momentum']} + {cs(('mom IS NULL', 0.0), ('tsc > 0.7', 1.0), ('tsc < 0.3', -1.0))} * {_W['momentum']}
 + {cs(('vol_ratio > 1.3', 1.0), ('vol_ratio > 1.1', 0.5))} * {_W['volatility']} AS score FROM m2)"""


@query("model_momentum", f"WITH {Q.BARS}, {MOM_SQL} SELECT ticker, ts, round(score, 4) AS score, CASE WHEN r >= 20 AND score >= 6.5 THEN 1 WHEN r >= 20 AND score <= -6.5 THEN -1 ELSE 0 END AS signal FROM mm")
def model_momentum(spark, sf):
    return S.unblock(C.momentum_model(S.blocked(V.bars_1d(spark, sf)))).select("ticker", "ts", r(c("score")).alias("score"), "signal")


_R = C.WEIGHTS["reversion"]
REVM_SQL = f"""{feature_sql('reversion')}, r1 AS (SELECT *, (close - sma_slow) / nullif(sma_slow, 0) * 100 AS dist, (close - sup) / nullif(res - sup, 0) AS sr FROM fx),
 r2 AS (SELECT *, {cs(('sma_slow IS NULL', 0.0), ('sma_fast > sma_slow', 1.0), default='-1.0')} * {_R['ma_cross']} + {cs(('dist < -2', 1.5), ('dist > 2', -1.5))} * {_R['ma_cross']}
 + {cs(('rsi < 30', 2.5), ('rsi < 35', 1.5), ('rsi > 70', -2.5), ('rsi > 65', -1.5))} * {_R['rsi']} + {cs(('rsi < rsi_ma AND rsi < 40', 0.5))} * {_R['rsi']}
 + {cs(('k IS NULL OR kd IS NULL', 0.0), ('k < 30', 1.5), ('k > 70', -1.5))} * {_R['stoch']} + {cs(('k > kd + 1e-9 AND k < 30', 1.0), ('k < kd - 1e-9 AND k > 70', -1.0))} * {_R['stoch']}
 + {cs(('bp < 0.1', 2.0), ('bp > 0.9', -2.0))} * {_R['bb']} + {cs(('bz > 2', -1.0), ('bz < -2', 1.0))} * {_R['bb']} + {cs(('bp IS NOT NULL AND bw > 0.015 AND bw < 0.03', 0.5))} * {_R['bb']}
 + {cs(('hist > 0 AND ph <= 0', 1.5), ('hist < 0 AND ph >= 0', -1.5))} * {_R['macd']} AS s1 FROM r1),
 r3 AS (SELECT *, CASE WHEN volume_ratio > 0.8 AND volume_ratio < 1.5 THEN s1 + 0.5 * {_R['volume']} WHEN volume_ratio > 2 THEN s1 * 0.8 ELSE s1 END
 + {cs(('roc_mean > 0.5 AND roc_mean < 2', 1.0), ('roc_mean > -2 AND roc_mean < -0.5', -1.0))} * {_R['momentum']} + {cs(('roc_mean IS NULL', 0.0), ('sr < 0.2', 0.5), ('sr > 0.8', -0.5))} * {_R['momentum']}
 - {cs(('vol_rank < 0.3', 1.0), ('vol_rank > 0.7', 1.5))} * {_R['volatility']} AS score FROM r2),
 r4 AS (SELECT *, CASE WHEN r < 20 OR coalesce(vol_rank > 0.8, false) OR coalesce(abs(dist) > 5, false) OR coalesce(volume_ratio < 0.3, false) THEN 0 WHEN score >= 6 THEN 1 WHEN score <= -6 THEN -1 ELSE 0 END AS sig FROM r3)"""


@query("model_reversion", f"""WITH {Q.BARS}, {REVM_SQL} SELECT ticker, ts, round(score, 4) AS score, CASE WHEN sum(abs(sig)) OVER (PARTITION BY ticker, CAST(ts AS DATE) ORDER BY ts) <= 1 THEN sig ELSE 0 END AS signal FROM r4""")
def model_reversion(spark, sf):
    return C.reversion_model(S.blocked(V.bars_1d(spark, sf))).select("ticker", "ts", r(c("score")).alias("score"), "signal")


# ------------------------------------------------------------------ daily candle scan

DAILY_SCAN_SQL = f"""{Q.numbered()}, d0 AS (SELECT *, {Q.TR} AS tr FROM s), d1 AS (SELECT *, {Q.ema('tr', S.wilder(14))} AS atr, {Q.ema(Q.GAIN, S.wilder(14))} AS u, {Q.ema(Q.LOSS, S.wilder(14))} AS v,
 volume / nullif({Q.mean('volume', 20)}, 0) AS volume_ratio, {Q.mean('close', 20)} AS sma_20, {Q.mean('close', 50)} AS sma_50, close / nullif(lag(close, 5) {Q.ROW}, 0) - 1 AS chg5,
 close / nullif(lag(close, 20) {Q.ROW}, 0) - 1 AS chg20, lead(open) {Q.ROW} AS next_open, {Q.mean('close', 5)} AS bm, {Q.full('stddev_pop', 'close', 5)} AS bsd FROM d0),
 d2 AS (SELECT *, {Q.rsi('u', 'v')} AS rsi, atr / nullif(close, 0) * 100 AS atr_pct, (close - (bm - 2 * bsd)) / nullif(4 * bsd, 0) AS bp FROM d1), {CANDLE_SQL.format(src='d2')}, {CANDLE_EVENTS_SQL},
 pc_cfg AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}', {m}, {h}, {s})" for a, b, m, h, s in C.PATTERN_CONFIG)}) AS t(pattern, signal_type, conf_mult, hold, success)),
 x0 AS (SELECT ce.*, signal_type, CAST(conf_mult AS DOUBLE) AS conf_mult, hold, CAST(success AS DOUBLE) AS success FROM ce JOIN pc_cfg USING (pattern) WHERE r >= 20 AND next_open IS NOT NULL),
 x1 AS (SELECT *, greatest(0.0, least(1.0, 0.5 + CASE signal_type WHEN 'bullish' THEN {cs(('chg5 < -0.03', 0.3), ('chg20 > 0 AND close > sma_20', 0.2), ('close < sma_20 AND sma_20 < coalesce(sma_50, sma_20)', 0.4))}
 WHEN 'bearish' THEN {cs(('chg5 > 0.03', 0.3), ('chg20 < 0 AND close < sma_20', 0.2), ('close > sma_20 AND sma_20 > coalesce(sma_50, sma_20)', 0.4))}
 WHEN 'reversal' THEN {cs(('abs(chg20) > 0.05', 0.4), default='-0.2')} ELSE 0 END)) AS align FROM x0),
 x2 AS (SELECT *, greatest(0.0, least(1.0, 0.5 + {cs(('volume_ratio > 1.8', 0.15), ('volume_ratio > 1.2', 0.05))} + {cs(('atr_pct > 2.5', 0.1), ('atr_pct < 0.8', -0.1))} + 0.2 * align
 + {cs(("signal_type = 'bullish' AND rsi < 40", 0.1), ("signal_type = 'bearish' AND rsi > 60", 0.1))} + {cs(("signal_type = 'bullish' AND bp < 0.3", 0.05), ("signal_type = 'bearish' AND bp > 0.7", 0.05))}
 + {cs(('abs(chg5) > 0.02', 0.05))})) AS validation FROM x1),
 x3 AS (SELECT *, greatest(0.1, least(0.98, validation * conf_mult * 1.2 * (0.5 + success) * {cs(('volume_ratio > 2', 1.1), ('volume_ratio < 0.7', 0.9), default='1.0')})) AS confidence,
 CASE signal_type WHEN 'bullish' THEN 'BUY' WHEN 'bearish' THEN 'SELL' WHEN 'reversal' THEN CASE WHEN direction = 'bullish' THEN CASE WHEN chg5 < 0 THEN 'BUY' ELSE 'SELL' END
 ELSE CASE WHEN chg5 > 0 THEN 'SELL' ELSE 'BUY' END END ELSE 'HOLD' END AS signal, CAST(floor(hold * 1.1) AS INTEGER) AS holding,
 CASE WHEN chg5 IS NULL OR chg20 IS NULL THEN 'Unknown' WHEN chg5 > 0.02 AND chg20 > 0.05 THEN 'Strong Uptrend' WHEN chg5 > 0.01 OR chg20 > 0.02 THEN 'Uptrend'
 WHEN chg5 < -0.02 AND chg20 < -0.05 THEN 'Strong Downtrend' WHEN chg5 < -0.01 OR chg20 < -0.02 THEN 'Downtrend' ELSE 'Sideways' END AS trend_context FROM x2 WHERE validation >= 0.65 - 1e-9),
 ds AS (SELECT *, CASE signal WHEN 'BUY' THEN close - 2.5 * coalesce(atr, close * 0.02) WHEN 'SELL' THEN close + 2.5 * coalesce(atr, close * 0.02) END AS stop_loss,
 CASE signal WHEN 'BUY' THEN close + 4 * coalesce(atr, close * 0.02) WHEN 'SELL' THEN close - 4 * coalesce(atr, close * 0.02) END AS take_profit FROM x3)"""


def _scored(spark, sf):
    df = C.daily_features(S.blocked(V.bars_1d(spark, sf)))
    df = S.unblock(K.add_daily_candles(df))
    keep = [x for x in df.columns if x not in [t[0] for t in K.DAILY_CANDLES]]
    e = K.events_from_flags(df, K.DAILY_CANDLES, keep)
    e = e.join(F.broadcast(C.pattern_config(spark)), "pattern")
    return C.daily_candle_scan(J.with_config(e, C.ticker_config(spark), "ticker", C.TICKER_DEFAULT), 0.65 - 1e-9)


@query("scan_daily_candles", f"WITH {Q.BARS}, {DAILY_SCAN_SQL} SELECT ticker, ts, pattern, signal, trend_context, holding, {sel(validation='validation', confidence='confidence', stop_loss='stop_loss', take_profit='take_profit')} FROM ds")
def scan_daily_candles(spark, sf):
    return _scored(spark, sf).select("ticker", "ts", "pattern", "signal", "trend_context", "holding",
                                     *[r(c(x)).alias(x) for x in ("validation", "confidence", "stop_loss", "take_profit")])


@query("scan_recommendation", f"""WITH {Q.BARS}, {DAILY_SCAN_SQL}, k AS (SELECT *, round(confidence, 9) AS cr FROM ds),
 n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY cr DESC, ts DESC, pattern) AS rn, count(*) OVER (PARTITION BY ticker) AS cnt FROM k)
 SELECT ticker, ts, pattern, signal, holding, trend_context, least(cnt, 3) AS supporting, {sel(confidence='cr', stop_loss='stop_loss', take_profit='take_profit')},
 CASE WHEN cr >= 0.78 THEN 'Strong' ELSE 'Moderate' END AS strength, CAST(CAST(ts AS DATE) + holding AS VARCHAR) AS expires FROM n WHERE rn = 1""")
def scan_recommendation(spark, sf):
    e = _scored(spark, sf).withColumn("confidence", r(c("confidence"), 9))
    return C.recommend(e).select("ticker", "ts", "pattern", "signal", "holding", "trend_context", "supporting",
                                 *[r(c(x)).alias(x) for x in ("confidence", "stop_loss", "take_profit")], "strength", c("expires").cast("string").alias("expires"))


_VC = cs(("volume_ratio0 > 1.5 * 1.8", 0.9), ("volume_ratio0 > 1.2 * 1.8", 0.7), ("volume_ratio0 > 0.8 * 1.8", 0.5), ("volume_ratio0 IS NULL", 0.5), default="0.3")


@query("scan_next_day", f"""WITH {Q.BARS}, {Q.numbered()}, e0 AS (SELECT *, CASE WHEN r >= 20 THEN volume / nullif(avg(volume) {Q.over(20, 1)}, 0) END AS volume_ratio0 FROM s), {CANDLE_SQL.format(src='e0')}, {CANDLE_EVENTS_SQL},
 g AS (SELECT ticker, count(*) AS patterns, count(*) FILTER (direction = 'bullish') AS bullish, count(*) FILTER (direction = 'bearish') AS bearish, count(*) FILTER (direction = 'neutral') AS neutral,
 sum(CASE WHEN direction = 'bullish' THEN strength * {_VC} ELSE 0 END) AS bull, sum(CASE WHEN direction = 'bearish' THEN strength * {_VC} ELSE 0 END) AS bear FROM ce GROUP BY 1)
 SELECT ticker, patterns, bullish, bearish, neutral, round(bull, 4) AS bull, round(bear, 4) AS bear, CASE WHEN bull > bear * 1.5 THEN 'BUY' WHEN bear > bull * 1.5 THEN 'SELL' ELSE 'HOLD' END AS recommendation,
 round(CASE WHEN bull > bear * 1.5 THEN CASE WHEN bear > 0 THEN bull / (bull + bear) ELSE 0.9 END WHEN bear > bull * 1.5 THEN CASE WHEN bull > 0 THEN bear / (bull + bear) ELSE 0.9 END ELSE 0.5 END, 4) AS confidence FROM g""")
def scan_next_day(spark, sf):
    from barflow.operators import charts
    df = charts.add_volume_confirmation(S.blocked(V.bars_1d(spark, sf)), 1.8)
    df = S.unblock(K.add_daily_candles(df))
    e = K.events_from_flags(df, K.DAILY_CANDLES, ["ticker", "ts", "volume_confirmation"])
    return C.next_day_summary(e).select("ticker", "patterns", "bullish", "bearish", "neutral", r(c("bull")).alias("bull"), r(c("bear")).alias("bear"),
                                        "recommendation", r(c("confidence")).alias("confidence"))


@query("scan_vote", """WITH x AS (SELECT event_type AS ticker, CASE WHEN value > 15 THEN 'BUY' WHEN value < 8 THEN 'SELL' ELSE 'HOLD' END AS signal, least(value / 40, 1.0) AS confidence,
 user_id % 10 / 10.0 AS volume_score FROM events), y AS (SELECT *, confidence * 0.7 + confidence * volume_score * 0.3 AS adj FROM x),
 g AS (SELECT ticker, count(*) FILTER (signal = 'BUY' AND adj > 0.25) AS buys, count(*) FILTER (signal = 'SELL' AND adj > 0.25) AS sells, avg(volume_score) AS vs, avg(confidence) AS ac, avg(adj) AS aa FROM y GROUP BY 1),
 f AS (SELECT *, CASE WHEN vs < 0.3 THEN 0.7 WHEN vs > 0.7 THEN 1.2 ELSE 1.0 END AS k FROM g)
 SELECT ticker, buys, sells, round(vs, 4) AS volume_score, round(ac, 4) AS avg_confidence, round(aa, 4) AS avg_adjusted, CASE WHEN buys * k > sells * k * 1.5 THEN 'STRONG BUY' WHEN sells * k > buys * k * 1.5 THEN 'STRONG SELL'
 WHEN buys > sells THEN 'BUY' WHEN sells > buys THEN 'SELL' ELSE 'HOLD' END || CASE WHEN vs < 0.3 THEN ' (Low Volume Warning)' ELSE '' END AS recommendation FROM f""")
def scan_vote(spark, sf):
    g = C.vote(_event_signals(spark, sf))
    return g.select("ticker", "buys", "sells", *[r(c(x)).alias(x) for x in ("volume_score", "avg_confidence", "avg_adjusted")], "recommendation")


def _event_signals(spark, sf):
    e = V.table(spark, sf, "events")
    return e.select(c("event_type").alias("ticker"), F.when(c("value") > 15, "BUY").when(c("value") < 8, "SELL").otherwise("HOLD").alias("signal"),
                    F.least(c("value") / 40, F.lit(1.0)).alias("confidence"), (c("user_id") % 10 / 10.0).alias("volume_score"),
                    F.when(c("event_id") % 3 == 0, "1wk").otherwise("1d").alias("interval"), c("value").alias("close"), "ts", "event_id")


@query("scan_interval_vote", """WITH x AS (SELECT event_type AS ticker, CASE WHEN value > 15 THEN 'BUY' WHEN value < 8 THEN 'SELL' ELSE 'HOLD' END AS signal, CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 1.5 END AS w,
 user_id % 10 / 10.0 AS v FROM events), g AS (SELECT ticker, CAST(sum(CASE WHEN signal = 'BUY' THEN w ELSE 0 END) AS DOUBLE) AS b, CAST(sum(CASE WHEN signal = 'SELL' THEN w ELSE 0 END) AS DOUBLE) AS s, avg(v) AS v FROM x GROUP BY 1)
 SELECT ticker, b AS buy_score, s AS sell_score, round(v, 4) AS volume_score, CASE WHEN b > s * 1.5 AND v > 0.5 THEN 'STRONG BUY' WHEN s > b * 1.5 AND v > 0.5 THEN 'STRONG SELL' WHEN b > s THEN 'BUY' WHEN s > b THEN 'SELL' ELSE 'HOLD' END AS recommendation FROM g""")
def scan_interval_vote(spark, sf):
    return C.interval_vote(_event_signals(spark, sf)).withColumn("volume_score", r(c("volume_score")))


@query("scan_swing_targets", """SELECT event_id, round(value * CASE WHEN value > 15 THEN 0.97 ELSE 1.03 END, 4) AS stop_loss, round(value * CASE WHEN value > 15 THEN 1.05 ELSE 0.95 END, 4) AS target_1,
 round(value * CASE WHEN value > 15 THEN 1.1 ELSE 0.9 END, 4) AS target_2, round(0.05 / 0.03, 4) AS risk_reward FROM events WHERE value > 15 OR value < 8 AND value > 0""")
def scan_swing_targets(spark, sf):
    s = _event_signals(spark, sf).filter((c("signal") != "HOLD") & (c("close") > 0))
    return C.swing_targets(s).select("event_id", *[r(c(x)).alias(x) for x in ("stop_loss", "target_1", "target_2", "risk_reward")])


@query("scan_morning_selection", f"""WITH {Q.BARS}, {DAILY_SCAN_SQL}, n AS (SELECT * FROM ds WHERE ts >= (SELECT max(ts) FROM b) - INTERVAL '30 days'
 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, pattern) <= 5) SELECT ticker, ts, pattern, signal FROM n""")
def scan_morning_selection(spark, sf):
    newest = V.bars_1d(spark, sf).agg(F.max("ts").alias("newest"))
    return C.morning_selection(_scored(spark, sf), newest, days=30).select("ticker", "ts", "pattern", "signal")
