"""Chart patterns and volume confirmation: queries and their SQL."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from barflow.functions.scalar import r
from barflow.operators import candles as K, charts as H, indicators as I, joins as J, plugins as P, series as S
from barflow.plans import sql as Q
from barflow.plans.indicator_queries import VOLB_SQL, sel
from barflow.plans.registry import query
from barflow.sources import views as V

c = F.col
_P = "PARTITION BY ticker, d ORDER BY ts"
EXT_SQL = f"""e0 AS (SELECT *, CAST(ts AS DATE) AS d FROM b), e1 AS (SELECT *, row_number() OVER ({_P}) - 1 AS i,
 CASE WHEN high > lag(high) OVER ({_P}) AND high > lead(high) OVER ({_P}) AND high = max(high) OVER ({_P} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) THEN 1 ELSE 0 END AS peak,
 CASE WHEN low < lag(low) OVER ({_P}) AND low < lead(low) OVER ({_P}) AND low = min(low) OVER ({_P} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) THEN 1 ELSE 0 END AS trough,
 high - greatest(min(high) OVER ({_P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), min(high) OVER ({_P} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS pp,
 least(max(low) OVER ({_P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), max(low) OVER ({_P} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) - low AS tp FROM e0),
 ses AS (SELECT ticker, d, last(close ORDER BY ts) AS cp, count(*) AS n, avg(volume) FILTER (i >= cnt - 5) AS rv FROM (SELECT *, count(*) OVER (PARTITION BY ticker, d) AS cnt FROM e1) GROUP BY 1, 2)"""


def _hs_sql(name, sign):
    top, bot, tv, bv = ("peak", "trough", "high", "low") if sign == 1 else ("trough", "peak", "low", "high")
    return f"""t_{name} AS (SELECT ticker, d, i, {tv} * {sign} AS v FROM e1 WHERE {top} = 1), m_{name} AS (SELECT ticker, d, i, {bv} * {sign} AS v FROM e1 WHERE {bot} = 1),
 l_{name} AS (SELECT p.ticker, p.d, p.i AS p, p.v AS pv, (SELECT x.i FROM t_{name} x WHERE x.ticker = p.ticker AND x.d = p.d AND x.i < p.i AND x.v < p.v ORDER BY x.v DESC, x.i DESC LIMIT 1) AS l,
 (SELECT x.i FROM t_{name} x WHERE x.ticker = p.ticker AND x.d = p.d AND x.i > p.i AND x.v < p.v ORDER BY x.v DESC, x.i LIMIT 1) AS rr FROM t_{name} p),
 k_{name} AS (SELECT *, (SELECT x.i FROM m_{name} x WHERE x.ticker = q.ticker AND x.d = q.d AND x.i > q.l AND x.i < q.p ORDER BY x.v, x.i LIMIT 1) AS lt,
 (SELECT x.i FROM m_{name} x WHERE x.ticker = q.ticker AND x.d = q.d AND x.i > q.p AND x.i < q.rr ORDER BY x.v, x.i LIMIT 1) AS rt FROM l_{name} q WHERE l IS NOT NULL AND rr IS NOT NULL),
 f_{name} AS (SELECT * FROM k_{name} WHERE lt IS NOT NULL AND rt IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker, d ORDER BY p) = 1),
 {name} AS (SELECT f.ticker, f.d, f.l AS p0, f.lt AS p1, f.p AS p2, f.rt AS p3, f.rr AS p4, f.pv * {sign} AS head, r1.{tv} AS rgt, (a.{bv} + z.{bv}) / 2 AS neck FROM f_{name} f JOIN e1 r1 ON r1.ticker = f.ticker AND r1.d = f.d AND r1.i = f.rr
 JOIN e1 a ON a.ticker = f.ticker AND a.d = f.d AND a.i = f.lt JOIN e1 z ON z.ticker = f.ticker AND z.d = f.d AND z.i = f.rt)"""


def _dbl_sql(name, bottom):
    top, tv, tpv, bot, bv, order = ("trough", "low", "tp", "peak", "high", "DESC") if bottom else ("peak", "high", "pp", "trough", "low", "ASC")
    return f"""t_{name} AS (SELECT ticker, d, i, {tv} AS v, lead(i) OVER w AS j, lead({tv}) OVER w AS w2 FROM e1 WHERE {top} = 1 AND {tpv} >= 0.1 WINDOW w AS (PARTITION BY ticker, d ORDER BY i)),
 k_{name} AS (SELECT *, (SELECT x.i FROM e1 x WHERE x.{bot} = 1 AND x.ticker = t.ticker AND x.d = t.d AND x.i > t.i AND x.i < t.j ORDER BY x.{bv} {order}, x.i LIMIT 1) AS m FROM t_{name} t WHERE abs(v - w2) < 0.05 * (v + w2) / 2),
 {name} AS (SELECT k.ticker, k.d, k.i AS p0, k.m AS p1, k.j AS p2, k.v AS head, k.w2 AS rgt, x.{bv} AS neck FROM k_{name} k JOIN e1 x ON x.ticker = k.ticker AND x.d = k.d AND x.i = k.m
 QUALIFY row_number() OVER (PARTITION BY k.ticker, k.d ORDER BY k.i) = 1)"""


def _levels_sql(src, pattern, sell, double):
    lvl = "(head + rgt) / 2" if double else "head"
    guard = lvl if double else "rgt"
    k, h = ("0.99", f"neck - abs({lvl} - neck) * {0.8 if double else 1.0}") if sell else ("1.01", f"neck + abs({lvl} - neck) * {0.8 if double else 1.0}")
    g = "1.01" if sell else "0.99"
    last = "p2" if double else "p4"
    conf = f"""greatest(0, least(100, 50 + (1 - abs(head - rgt) / ((head + rgt) / 2)) * 30 + CASE WHEN (SELECT avg(volume) FROM e1 x WHERE x.ticker = q.ticker AND x.d = q.d AND x.i BETWEEN p0 AND {last}) > rv * 1.2 THEN 10 ELSE 0 END
 - CASE WHEN n - {last} < 5 THEN 10 ELSE 0 END))""" if double else "50.0"
    pts = "p0 || '-' || p1 || '-' || p2" + ("" if double else " || '-' || p3 || '-' || p4")
    return f"""SELECT ticker, CAST(d AS VARCHAR) AS date, '{pattern}' AS pattern, {pts} AS points, '{'SELL' if sell else 'BUY'}' AS action, round(neck * {k}, 4) AS entry, round({guard} * {g}, 4) AS stop_loss, round({h}, 4) AS target,
 round(coalesce(abs({h} - neck * {k}) / nullif(abs(neck * {k} - {guard} * {g}), 0), 0), 4) AS risk_reward, round(abs(cp - neck * {k}) / nullif(cp, 0) * 100, 4) AS distance_pct, round({conf}, 4) AS confidence FROM (SELECT * FROM {src} JOIN ses USING (ticker, d)) q"""


def _show(df):
    return df.select("ticker", c("date").cast("string").alias("date"), "pattern", F.array_join("points", "-").alias("points"), "action",
                     *[r(c(x)).alias(x) for x in ("entry", "stop_loss", "target", "risk_reward", "distance_pct", "confidence")])


@query("chart_extrema", f"WITH {Q.BARS_15M}, {EXT_SQL} SELECT ticker, ts, peak, trough, round(pp, 4) AS peak_prom, round(tp, 4) AS trough_prom FROM e1")
def chart_extrema(spark, sf):
    return H.session_extrema(V.bars_15m(spark, sf)).select("ticker", "ts", "peak", "trough", r(c("peak_prom")).alias("peak_prom"), r(c("trough_prom")).alias("trough_prom"))


@query("chart_head_and_shoulders", f"WITH {Q.BARS_15M}, {EXT_SQL}, {_hs_sql('hs', 1)}, {_hs_sql('ih', -1)} {_levels_sql('hs', 'Head and Shoulders', True, False)} UNION ALL {_levels_sql('ih', 'Inverse Head and Shoulders', False, False)}")
def chart_head_and_shoulders(spark, sf):
    ex = H.session_extrema(V.bars_15m(spark, sf))
    return _show(H.trade_levels(H.head_and_shoulders(ex).unionByName(H.head_and_shoulders(ex, True))))


@query("chart_double_extremes", f"WITH {Q.BARS_15M}, {EXT_SQL}, {_dbl_sql('dt', False)}, {_dbl_sql('db', True)} {_levels_sql('dt', 'Double Top', True, True)} UNION ALL {_levels_sql('db', 'Double Bottom', False, True)}")
def chart_double_extremes(spark, sf):
    ex = H.session_extrema(V.bars_15m(spark, sf))
    return _show(H.trade_levels(H.double_extreme(ex).unionByName(H.double_extreme(ex, True))))


POT_SQL = f"""{Q.numbered()}, p0 AS (SELECT *, {Q.mean(Q.GAIN, 14)} AS u, {Q.mean(Q.LOSS, 14)} AS v, {Q.mean('close', 20)} AS s20, {Q.mean('close', 50)} AS s50, max(close) {Q.over(5, 1)} AS mx, min(close) {Q.over(5, 1)} AS mn,
 CASE WHEN r >= 20 THEN volume / nullif(avg(volume) {Q.over(20, 1)}, 0) END AS vr, coalesce(lead(open) {Q.ROW}, close * 1.001) AS entry FROM s), p1 AS (SELECT *, coalesce({Q.rsi('u', 'v')}, 50) AS rsi FROM p0),
 po AS (SELECT *, CASE WHEN r >= 50 THEN CASE WHEN close > s20 AND rsi > 70 AND close > mx * 0.98 THEN 'Potential Double Top' WHEN close < s20 AND rsi < 30 AND close < mn * 1.02 THEN 'Potential Double Bottom'
 WHEN s20 > s50 AND rsi > 50 AND rsi < 70 AND close > s20 THEN 'Ascending Triangle Pattern' WHEN s20 < s50 AND rsi < 50 AND rsi > 30 AND close < s20 THEN 'Descending Triangle Pattern' END END AS chart_pattern,
 CASE WHEN vr IS NULL THEN 0.5 WHEN vr > {1.5 * 1.2!r} THEN 0.9 WHEN vr > {1.2 * 1.2!r} THEN 0.7 WHEN vr > {0.8 * 1.2!r} THEN 0.5 ELSE 0.3 END AS vc FROM p1)"""


@query("chart_potential_patterns", f"WITH {Q.BARS}, {POT_SQL} SELECT ticker, ts, chart_pattern AS pattern, round(vc, 4) AS volume_confirmation, round(entry, 4) AS entry_price FROM po WHERE chart_pattern IS NOT NULL")
def chart_potential_patterns(spark, sf):
    df = H.add_volume_confirmation(H.add_potential_patterns(S.blocked(V.bars_1d(spark, sf))), 1.2)
    df = S.unblock(df.withColumn("entry_price", H.entry_price())).filter(c("chart_pattern").isNotNull())
    return df.select("ticker", "ts", c("chart_pattern").alias("pattern"), r(c("volume_confirmation")).alias("volume_confirmation"), r(c("entry_price")).alias("entry_price"))


_N21 = f"list(volume) {Q.over(21)}"
ENH_SQL = f"""{POT_SQL}, q0 AS (SELECT *, {_N21} AS vl, avg(volume) {Q.over(21)} AS va, {Q.TR} AS tr, sum((high + low + close) / 3 * volume) {Q.RUN} / nullif(sum(volume) {Q.RUN}, 0) AS vw FROM po),
 q1 AS (SELECT *, vl[1] AS v1, vl[len(vl)] AS v3, vl[len(vl) // 2 + 1] AS v2, {Q.ema('tr', S.wilder(14))} AS atr FROM q0),
 q2 AS (SELECT *, ((CASE WHEN v2 > va * 1.2 THEN 1 ELSE 0 END) + (CASE WHEN v3 < v1 * 0.9 THEN 1 ELSE 0 END) + (CASE WHEN v3 < va THEN 1 ELSE 0 END)) / 3.0 AS hsr,
 ((CASE WHEN v3 < v1 * 0.85 THEN 1 ELSE 0 END) + (CASE WHEN v1 > va THEN 1 ELSE 0 END) + (CASE WHEN v3 < va * 0.9 THEN 1 ELSE 0 END)) / 3.0 AS dtr, atr / nullif(close, 0) * 100 AS atr_pct, (close - vw) / nullif(vw, 0) * 100 AS dev FROM q1),
 q3 AS (SELECT *, chart_pattern LIKE '%Double%' AND dtr > 0.5 AS valid, 60.0 AS conf, CASE WHEN chart_pattern IN ('Potential Double Top', 'Descending Triangle Pattern') THEN 'bearish' ELSE 'bullish' END AS direction FROM q2 WHERE chart_pattern IS NOT NULL),
 q4 AS (SELECT *, CASE WHEN valid THEN least(conf + 10 * dtr, 100) ELSE conf * 0.8 END AS adj FROM q3),
 q5 AS (SELECT *, least(100, adj / 100 * 30 + CASE WHEN valid THEN dtr * 25 ELSE 0 END + CASE WHEN direction = 'bullish' AND dev < 0 THEN least(abs(dev) * 4, 20) WHEN direction = 'bearish' AND dev > 0 THEN least(dev * 4, 20) ELSE 0 END
 + CASE WHEN atr_pct > 2 THEN 15 WHEN atr_pct > 1 THEN 10 ELSE 5 END + 7) AS quality FROM q4)"""


@query("chart_enhanced", f"WITH {Q.BARS}, {ENH_SQL} SELECT ticker, ts, chart_pattern AS pattern, CAST(valid AS INTEGER) AS volume_validated, " + sel(
    hs_reliability="hsr", dt_reliability="dtr", atr="atr", vwap_deviation="dev", volatility_threshold="greatest(atr_pct * 0.25, 0.1)", adjusted_confidence="adj", quality="quality") + " FROM q5")
def chart_enhanced(spark, sf):
    bars = V.bars_1d(spark, sf)
    pats = S.unblock(H.add_potential_patterns(S.blocked(bars))).filter(c("chart_pattern").isNotNull()).select(
        "ticker", "ts", c("chart_pattern").alias("pattern"), F.lit("chart").alias("kind"), F.lit(60.0).alias("confidence"),
        F.when(c("chart_pattern").isin("Potential Double Top", "Descending Triangle Pattern"), "bearish").otherwise("bullish").alias("direction"))
    ctx = S.unblock(H.add_volume_validation(H.add_context(S.blocked(bars, carry=I.vwap_carry())))).select(
        "ticker", "ts", "hs_reliability", "dt_reliability", "atr", "atr_pct", "vwap_deviation", "volatility_threshold")
    e = H.enhance_patterns(pats, ctx).withColumn("quality", H.quality_score())
    return e.select("ticker", "ts", "pattern", "volume_validated", *[r(c(x).cast("double")).alias(x) for x in (
        "hs_reliability", "dt_reliability", "atr", "vwap_deviation", "volatility_threshold", "adjusted_confidence", "quality")])


def _points_sql(src, pattern, sell, double):
    """Pattern rows with the volume checks at their own points, the bar of the last one and their confidence."""
    last = "p2" if double else "p4"
    vol = lambda i: f"(SELECT volume FROM e1 x WHERE x.ticker = q.ticker AND x.d = q.d AND x.i = q.{i})"
    avg = f"(SELECT avg(volume) FROM e1 x WHERE x.ticker = q.ticker AND x.d = q.d AND x.i BETWEEN q.p0 AND q.{last})"
    conf = f"""greatest(0, least(100, 50 + (1 - abs(head - rgt) / ((head + rgt) / 2)) * 30 + CASE WHEN {avg} > rv * 1.2 THEN 10 ELSE 0 END - CASE WHEN n - {last} < 5 THEN 10 ELSE 0 END))""" if double else "50.0"
    checks = ("v3 < v1 * 0.85", "v1 > va", "v3 < va * 0.9") if double else ("v2 > va * 1.2", "v3 < v1 * 0.9", "v3 < va")
    rel = " + ".join(f"CASE WHEN {x} THEN 1 ELSE 0 END" for x in checks)
    return f"""SELECT ticker, d, i, '{pattern}' AS pattern, 'chart' AS kind, '{'bearish' if sell else 'bullish'}' AS direction, conf, ({rel}) / 3.0 AS rel, ({rel}) / 3.0 > {0.5 if double else 0.6} AS valid
 FROM (SELECT ticker, d, {last} AS i, {conf} AS conf, {vol('p0')} AS v1, {vol('p2')} AS v2, {vol(last)} AS v3, {avg} AS va FROM {src} q JOIN ses USING (ticker, d))"""


_C3 = "(close - open) {s} 0 AND (lag(close) {o} - lag(open) {o}) {s} 0 AND (lag(close, 2) {o} - lag(open, 2) {o}) {s} 0 AND close {s} lag(close) {o} AND lag(close) {o} {s} lag(close, 2) {o}"
POINT_SQL = f"""{EXT_SQL}, {_hs_sql('hs', 1)}, {_hs_sql('ih', -1)}, {_dbl_sql('dt', False)}, {_dbl_sql('db', True)}, s AS (SELECT *, row_number() {Q.ROW} - 1 AS r, lag(close) {Q.ROW} AS pc FROM e1),
 ca AS (SELECT ticker, d, i, CASE WHEN {_C3.format(s='>', o=Q.ROW)} THEN 1 WHEN {_C3.format(s='<', o=Q.ROW)} THEN -1 ELSE 0 END AS c3 FROM s),
 pt AS ({_points_sql('hs', 'Head and Shoulders', True, False)} UNION ALL {_points_sql('ih', 'Inverse Head and Shoulders', False, False)} UNION ALL {_points_sql('dt', 'Double Top', True, True)} UNION ALL {_points_sql('db', 'Double Bottom', False, True)}
 UNION ALL SELECT ticker, d, i, CASE WHEN c3 = 1 THEN 'Three White Soldiers' ELSE 'Three Black Crows' END, 'candlestick', CASE WHEN c3 = 1 THEN 'bullish' ELSE 'bearish' END, 90.0, NULL, false FROM ca WHERE c3 <> 0),
 x0 AS (SELECT *, {Q.TR} AS tr, sum((high + low + close) / 3 * volume) {Q.RUN} / nullif(sum(volume) {Q.RUN}, 0) AS vw FROM s), x1 AS (SELECT *, {Q.ema('tr', S.wilder(14))} AS atr FROM x0),
 x2 AS (SELECT pt.*, x1.ts, atr, atr / nullif(close, 0) * 100 AS atr_pct, (close - vw) / nullif(vw, 0) * 100 AS dev FROM pt JOIN x1 USING (ticker, d, i)), x3 AS (SELECT *, CASE WHEN kind <> 'chart' THEN conf WHEN valid THEN least(conf + 10 * rel, 100) ELSE conf * 0.8 END AS adj FROM x2),
 x4 AS (SELECT *, least(100, adj / 100 * 30 + CASE WHEN valid THEN rel * 25 WHEN kind = 'candlestick' THEN 15 ELSE 0 END + CASE WHEN direction = 'bullish' AND dev < 0 THEN least(abs(dev) * 4, 20) WHEN direction = 'bearish' AND dev > 0 THEN least(dev * 4, 20) ELSE 0 END
 + CASE WHEN atr_pct > 2 THEN 15 WHEN atr_pct > 1 THEN 10 ELSE 5 END + CASE WHEN kind = 'candlestick' THEN 10 ELSE 7 END) AS quality FROM x3)"""


@query("chart_enhanced_points", f"WITH {Q.BARS_15M}, {POINT_SQL} SELECT ticker, ts, pattern, kind, direction, CAST(valid AS INTEGER) AS volume_validated, {sel(reliability='rel', atr='atr', vwap_deviation='dev', confidence='conf', adjusted_confidence='adj', quality='quality')} FROM x4")
def chart_enhanced_points(spark, sf):
    """Head-and-shoulders and double patterns with volume at their own points, and three-candle patterns, with context and quality."""
    bars = V.bars_15m(spark, sf)
    ex = H.session_extrema(bars)
    found = [H.head_and_shoulders(ex), H.head_and_shoulders(ex, True), H.double_extreme(ex), H.double_extreme(ex, True)]
    charts = H.trade_levels(H.add_point_volume(reduce(DataFrame.unionByName, found))).select(
        "ticker", "date", "no", "pattern", F.lit("chart").alias("kind"), F.when(c("action") == "SELL", "bearish").otherwise("bullish").alias("direction"), "confidence",
        "hs_reliability", "dt_reliability")
    no = F.row_number().over(Window.partitionBy("ticker", "date").orderBy("ts")).cast("int") - 1
    flags = S.unblock(K.add_daily_candles(S.blocked(bars, 900))).withColumn("date", F.to_date("ts")).withColumn("no", no)
    none = F.lit(None).cast("double")
    three = flags.filter((c("white_soldiers") == 1) | (c("black_crows") == 1)).select(
        "ticker", "date", "no", F.when(c("white_soldiers") == 1, "Three White Soldiers").otherwise("Three Black Crows").alias("pattern"), F.lit("candlestick").alias("kind"),
        F.when(c("white_soldiers") == 1, "bullish").otherwise("bearish").alias("direction"), F.lit(90.0).alias("confidence"), none.alias("hs_reliability"), none.alias("dt_reliability"))
    ctx = S.unblock(H.add_context(S.blocked(bars, 900, carry=I.vwap_carry()))).withColumn("date", F.to_date("ts")).withColumn("no", no).select(
        "ticker", "date", "no", "ts", "atr", "atr_pct", "vwap_deviation")
    e = H.enhance_patterns(charts.unionByName(three), ctx, ("ticker", "date", "no")).withColumn("quality", H.quality_score())
    return e.select("ticker", "ts", "pattern", "kind", "direction", "volume_validated", *[r(c(x)).alias(x) for x in (
        "reliability", "atr", "vwap_deviation", "confidence", "adjusted_confidence", "quality")])


STR_SQL = f"""{VOLB_SQL}, g0 AS (SELECT *, avg(volume_ratio) {Q.over(3)} AS r3, max(volume_ratio) {Q.over(20)} AS rmax, first(close) {Q.over(20)} AS c0, avg(volume) {Q.over(5)} AS v5, avg(volume) {Q.over(5, 15)} AS v0,
 avg(obv) {Q.over(5)} AS o5, avg(obv) {Q.over(15, 5)} AS o15, lag(volume) {Q.ROW} AS pv, avg(volume_ratio) {Q.over(5)} AS rr5, CASE WHEN sign(d) = sign(obv - obv_sma) THEN 1 ELSE 0 END AS same FROM vb),
 g1 AS (SELECT *, CASE WHEN r3 > 1.5 THEN 0.8 WHEN r3 > 1.2 THEN 0.6 ELSE 0.4 END * 0.3 + CASE WHEN rmax > 2 THEN 0.9 WHEN rmax < 0.5 THEN 0.1 ELSE 0.5 END * 0.2 + CASE WHEN (close > c0) = (v5 > v0) THEN 0.7 ELSE 0.3 END * 0.1 AS base,
 CASE WHEN v5 > v0 THEN 'increasing' ELSE 'decreasing' END AS vtrend, avg(same) {Q.over(10)} AS agree FROM g0),
 g2 AS (SELECT *, CASE WHEN r >= 29 THEN base + 0.2 * CASE WHEN volume_sma_5 > volume_sma_20 THEN 0.7 ELSE 0.3 END + 0.2 * CASE WHEN obv > obv_sma THEN 0.8 ELSE 0.2 END ELSE 0.5 END AS bull,
 CASE WHEN r >= 29 THEN base + 0.2 * CASE WHEN volume_sma_5 <= volume_sma_20 THEN 0.7 ELSE 0.3 END + 0.2 * CASE WHEN obv <= obv_sma THEN 0.8 ELSE 0.2 END ELSE 0.5 END AS bear FROM g1)"""


def _adj_sql(s):
    x = f"(0.6 * 0.6 + {s} * 0.4)"
    return f"CASE WHEN {s} < 0.3 THEN {x} * 0.8 WHEN {s} > 0.8 THEN least({x} * 1.1, 1.0) ELSE {x} END"


@query("chart_volume_strength", f"WITH {Q.BARS}, {STR_SQL} SELECT ticker, ts, " + sel(bull="bull", bear="bear", adjusted=_adj_sql("bull")) + " FROM g2")
def chart_volume_strength(spark, sf):
    df = S.unblock(H.add_signal_strength(I.volume_bundle(V.bars_1d(spark, sf))))
    return df.select("ticker", "ts", r(c("score_bullish")).alias("bull"), r(c("score_bearish")).alias("bear"),
                     r(H.adjust_confidence(F.lit(0.6), c("score_bullish"))).alias("adjusted"))


@query("chart_volume_report", f"""WITH {Q.BARS}, {STR_SQL} SELECT ticker, ts, volume, {sel(avg_volume='avg_volume', volume_ratio='volume_ratio', volume_roc='volume_roc')}, vtrend AS volume_trend, CASE WHEN obv > obv_sma THEN 'bullish' ELSE 'bearish' END AS obv_signal,
 CASE WHEN volume_ratio > 1.5 THEN 1 ELSE 0 END AS unusual_volume, CASE WHEN volume_ratio > 1.2 THEN 'high' WHEN volume_ratio < 0.8 THEN 'low' ELSE 'normal' END AS volume_quality FROM g2""")
def chart_volume_report(spark, sf):
    df = H.volume_report(S.unblock(H.add_signal_strength(I.volume_bundle(V.bars_1d(spark, sf)))))
    return df.withColumns({x: r(c(x)) for x in ("avg_volume", "volume_ratio", "volume_roc")})


@query("chart_volume_scores", f"""WITH {Q.BARS}, {STR_SQL} SELECT ticker, ts, round(CASE WHEN r >= 20 THEN greatest(0, least(1, 0.5 + CASE WHEN r3 > 1.5 THEN 0.2 WHEN r3 > 1.2 THEN 0.1 WHEN r3 < 0.5 THEN -0.2 ELSE 0 END
 + CASE WHEN v5 > v0 THEN 0.15 ELSE 0 END + CASE WHEN obv > obv_sma THEN 0.15 ELSE 0 END)) ELSE 0.5 END, 4) AS interval_score, round(CASE WHEN r >= 20 THEN greatest(0, least(1, 0.5 + CASE WHEN v5 / nullif(avg_volume, 0) > 1.5 THEN 0.25
 WHEN v5 / nullif(avg_volume, 0) > 1.2 THEN 0.15 WHEN v5 / nullif(avg_volume, 0) < 0.5 THEN -0.2 ELSE 0 END + CASE WHEN volume > avg_volume * 1.5 AND volume > pv THEN 0.2 ELSE 0 END + CASE WHEN o5 > o15 THEN 0.15 ELSE 0 END)) ELSE 0.5 END, 4) AS daily_score,
 CASE WHEN volume > avg_volume * 1.5 AND volume > pv THEN 1 ELSE 0 END AS volume_breakout, CASE WHEN volume_ratio >= 0.8 AND volume_ratio <= 3 AND rr5 >= 0.5 AND agree >= 0.6 - 1e-9 THEN 1 ELSE 0 END AS admissible FROM g2""")
def chart_volume_scores(spark, sf):
    df = S.unblock(H.add_admissibility(H.add_interval_scores(I.volume_bundle(V.bars_1d(spark, sf)))))
    return df.select("ticker", "ts", r(c("interval_score")).alias("interval_score"), r(c("daily_score")).alias("daily_score"), "volume_breakout", "admissible")


@query("chart_volume_attached", f"""WITH {Q.BARS}, {STR_SQL}, pt AS (SELECT CAST(l_suppkey AS VARCHAR) AS ticker, l_shipdate + INTERVAL '36 hours' AS att, l_orderkey, l_linenumber, l_partkey FROM lineitem),
 a AS (SELECT pt.*, g2.ts AS t0, bull AS s0 FROM pt ASOF LEFT JOIN g2 ON pt.ticker = g2.ticker AND pt.att >= g2.ts), z AS (SELECT a.*, g2.ts AS t1, g2.bull AS s1 FROM a ASOF LEFT JOIN g2 ON a.ticker = g2.ticker AND a.att <= g2.ts),
 x AS (SELECT ticker, CASE WHEN t1 IS NULL OR att - t0 <= t1 - att THEN s0 ELSE s1 END AS score FROM z), y AS (SELECT *, ({_adj_sql('score')}) * 100 AS conf, CASE WHEN score > 0.6 THEN 'high' WHEN score < 0.4 THEN 'low' ELSE 'medium' END AS q FROM x)
 SELECT ticker, count(*) AS patterns, round(avg(score), 4) AS avg_score, round(avg(conf), 4) AS avg_confidence, count(*) FILTER (q = 'high') AS high, count(*) FILTER (q = 'medium') AS medium, count(*) FILTER (q = 'low') AS low FROM y WHERE score >= 0.4 - 1e-9 AND conf >= 40 GROUP BY 1""")
def chart_volume_attached(spark, sf):
    """Scores attached to patterns by the nearest bar, filtered, and summed up per ticker."""
    scored = S.unblock(H.add_signal_strength(I.volume_bundle(V.bars_1d(spark, sf)))).select("ticker", "ts", "score_bullish")
    pats = V.line_ticks(spark, sf).select("ticker", (c("ts") + F.expr("INTERVAL 36 HOURS")).alias("at"))
    x = J.asof_join(pats, scored, "at", ["score_bullish"], "nearest", S.DAY).select("ticker", c("hit.score_bullish").alias("score"))
    x = x.withColumn("conf", H.adjust_confidence(F.lit(0.6), c("score")) * 100).filter((c("score") >= 0.4 - 1e-9) & (c("conf") >= 40))
    return x.groupBy("ticker").agg(F.count(F.lit(1)).alias("patterns"), r(F.avg("score")).alias("avg_score"), r(F.avg("conf")).alias("avg_confidence"),
                                   F.count_if(c("score") > 0.6).alias("high"), F.count_if((c("score") <= 0.6) & (c("score") >= 0.4)).alias("medium"),
                                   F.count_if(c("score") < 0.4).alias("low"))


@query("chart_volume_wrapped", f"""WITH {Q.BARS}, {STR_SQL}, x AS (SELECT ticker, bull AS score FROM g2 WHERE close > open * 1.05), y AS (SELECT *, ({_adj_sql('score')}) * 100 AS conf FROM x)
 SELECT ticker, count(*) AS patterns, round(avg(score), 4) AS avg_score, round(avg(conf), 4) AS avg_confidence, count(*) FILTER (score > 0.6) AS high, count(*) FILTER (score <= 0.6 AND score >= 0.4) AS medium, count(*) FILTER (score < 0.4) AS low FROM y WHERE score >= 0.4 - 1e-9 AND conf >= 40 GROUP BY 1""")
def chart_volume_wrapped(spark, sf):
    """A caller's scanner (bars that close 5 % above their open) with volume scores, filtered and summed up by the wrapper."""
    surge = P.with_volume(lambda bars: bars.filter(c("close") > c("open") * 1.05).select("ticker", "ts", F.lit("surge").alias("pattern")), interval_s=S.DAY)
    s = surge(V.bars_1d(spark, sf))["summary"]
    return s.select("ticker", "patterns", r(c("avg_score")).alias("avg_score"), r(c("avg_confidence")).alias("avg_confidence"), "high", "medium", "low")
