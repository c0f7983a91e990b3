"""Candles, alert rules and intraday strategies: queries and their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from barflow.functions.scalar import r
from barflow.operators import alerts as A, bars as B, candles as K, series as S, strategies as T
from barflow.plans import sql as Q
from barflow.plans.indicator_queries import ADX_SQL, SESSION_SQL, TVM_SQL, daily_sql, sel, REV_SQL
from barflow.plans.registry import query
from barflow.sources import views as V

c = F.col

_L = {f"{x}{k}": f"lag({x}, {k}) {Q.ROW}" for x in ("open", "high", "low", "close") for k in (1, 2)}
CANDLE_SQL = f"""cs AS (SELECT *, close - open AS body, abs(close - open) AS ba, high - greatest(open, close) AS up, least(open, close) - low AS dn,
 {_L['open1']} AS o1, {_L['close1']} AS c1, {_L['close2']} AS c2, {_L['close1']} - {_L['open1']} AS b1, {_L['close2']} - lag(open, 2) {Q.ROW} AS b2,
 close > first(close) {Q.over(6)} AS up5 FROM {{src}}),
 cf AS (SELECT *, CASE WHEN b1 < 0 AND body > 0 AND open <= c1 AND close >= o1 THEN 1 ELSE 0 END AS bull_engulf,
 CASE WHEN b1 > 0 AND body < 0 AND open >= c1 AND close <= o1 THEN 1 ELSE 0 END AS bear_engulf,
 CASE WHEN ba > 0 AND dn > 2 * ba AND up < 0.3 * ba THEN 1 ELSE 0 END AS hammer_bar,
 CASE WHEN ba > 0 AND up > 2 * ba AND dn < 0.3 * ba THEN 1 ELSE 0 END AS shooting_star,
 CASE WHEN c1 IS NOT NULL AND ba < 0.1 * greatest(high - low, abs(high - c1), abs(low - c1)) THEN 1 ELSE 0 END AS doji,
 CASE WHEN body > 0 AND b1 > 0 AND b2 > 0 AND close > c1 AND c1 > c2 THEN 1 ELSE 0 END AS white_soldiers,
 CASE WHEN body < 0 AND b1 < 0 AND b2 < 0 AND close < c1 AND c1 < c2 THEN 1 ELSE 0 END AS black_crows FROM cs)"""
_FLAGS = ["bull_engulf", "bear_engulf", "hammer_bar", "shooting_star", "doji", "white_soldiers", "black_crows"]
CANDLE_EVENTS_SQL = "ce AS (" + " UNION ALL ".join(
    f"SELECT *, '{n}' AS pattern, '{d}' AS direction, CAST({s} AS DOUBLE) AS strength, {h} AS holding_days FROM cf WHERE {f} = 1"
    for f, n, d, s, h in K.DAILY_CANDLES) + ")"


def candle_frame(spark, sf):
    return K.add_daily_candles(K.add_prior_trend(S.blocked(V.bars_1w(spark, sf), 7 * S.DAY)))


WB = f"WITH {Q.WEEKS}, {CANDLE_SQL.format(src='wk')}"


@query("candle_flags", f"{WB} SELECT ticker, ts, {', '.join(_FLAGS)} FROM cf")
def candle_flags(spark, sf):
    return S.unblock(candle_frame(spark, sf)).select("ticker", "ts", *_FLAGS)


@query("candle_events", f"{WB}, {CANDLE_EVENTS_SQL} SELECT ticker, ts, pattern, direction, strength, holding_days, round(close, 4) AS price, round(high, 4) AS high, "
       "round(low, 4) AS low FROM ce")
def candle_events(spark, sf):
    e = K.events_from_flags(S.unblock(candle_frame(spark, sf)), K.DAILY_CANDLES, ["ticker", "ts", "close", "high", "low"])
    return e.select("ticker", "ts", "pattern", "direction", "strength", "holding_days", r(c("close")).alias("price"), r(c("high")).alias("high"),
                    r(c("low")).alias("low"))


@query("candle_reversal_direction", f"""{WB} SELECT ticker, ts, CASE WHEN bull_engulf + bear_engulf > 0 THEN CASE WHEN up5 THEN 'bearish' ELSE 'bullish' END END AS direction
 FROM cf WHERE bull_engulf + bear_engulf > 0""")
def candle_reversal_direction(spark, sf):
    df = S.unblock(candle_frame(spark, sf)).withColumn("either", c("bull_engulf") + c("bear_engulf"))
    return K.events_from_flags(df, [("either", "Engulfing", "reversal", 1.0, 2)], ["ticker", "ts"]).select("ticker", "ts", "direction")


@query("candle_market_bias", f"""{WB}, {CANDLE_EVENTS_SQL}, g AS (SELECT ticker, count(*) FILTER (direction = 'bullish') AS bullish,
 count(*) FILTER (direction = 'bearish') AS bearish, count(*) FILTER (direction = 'neutral') AS neutral FROM ce GROUP BY 1)
 SELECT *, round(bullish * 100.0 / nullif(bullish + bearish, 0), 4) AS bullish_pct, CASE WHEN bullish * 100.0 / nullif(bullish + bearish, 0) > 60 THEN 'BULLISH'
 WHEN bullish * 100.0 / nullif(bullish + bearish, 0) < 40 THEN 'BEARISH' ELSE 'NEUTRAL' END AS bias FROM g""")
def candle_market_bias(spark, sf):
    e = K.events_from_flags(S.unblock(candle_frame(spark, sf)), K.DAILY_CANDLES, ["ticker"])
    return K.market_bias(e).withColumn("bullish_pct", r(c("bullish_pct")))


@query("candle_library")
def candle_library(spark, sf):
    df = S.unblock(K.candle_library(S.blocked(V.bars_1w(spark, sf), 7 * S.DAY)))
    return K.library_events(df).groupBy("pattern", "value").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("ticker").alias("tickers"))


# ------------------------------------------------------------------ alerts: weekly triggers, daily cues

_SLOPE = "CASE WHEN r >= 4 THEN (-2 * lag({x}, 4) {o} - lag({x}, 3) {o} + lag({x}) {o} + 2 * {x}) / 10 END"
FAST_SQL = f"""{Q.numbered('b', 'fs')}, fo AS (SELECT *, sum(coalesce(sign(d), 0) * volume) {Q.RUN} AS obv, {Q.ema('close', S.span(24))} AS ema_24,
 {Q.ema(Q.GAIN, S.wilder(14))} AS wu, {Q.ema(Q.LOSS, S.wilder(14))} AS wv, volume / nullif(avg(volume) {Q.over(24)}, 0) AS spike, {REV_SQL} FROM fs),
 fa AS (SELECT *, {Q.rsi('wu', 'wv')} AS rsi_14, obv - lag(obv) {Q.ROW} AS obv_delta, (obv - lag(obv, 2) {Q.ROW}) / 2 AS obv_slope3,
 {_SLOPE.format(x='obv', o=Q.ROW)} AS os, {_SLOPE.format(x='close', o=Q.ROW)} AS ps, lag(high) {Q.ROW} AS p_high, lag(volume) {Q.ROW} AS p_volume, r + 1 AS bars FROM fo)"""
SLOW_SQL = f"""{daily_sql('wk', 'w_')}, sl AS (SELECT *, lag(ema_20) {Q.ROW} AS pe20, lag(ema_50) {Q.ROW} AS pe50, avg(bar_range) {Q.over(5)} AS r5,
 avg(bar_range) {Q.over(20)} AS r20, r + 1 AS bars FROM w_day)"""
_RULE_SQL = {
    "Golden Cross": "s.bars >= 50 AND f.bars >= 24 AND s.ema_20 > s.ema_50 AND pe20 <= pe50 AND s.close >= sma_50 AND s.rsi_14 > 55 AND f.close > ema_24 AND spike >= 1.2",
    "20-EMA Bounce": "s.bars >= 50 AND f.bars >= 24 AND s.close > ema_20 AND ema_20 > ema_50 AND s.low <= ema_20 AND s.close > s.open AND (f.hammer <> 0 OR f.engulfing <> 0) AND obv_delta > 0",
    "NR7 + Inside Bar Breakout": "s.bars >= 252 AND nr7 = 1 AND s.inside_bar = 1 AND bb_pos < 0.2 AND spike >= 1.5",
    "52-Week High Breakout": "s.bars >= 252 AND s.close >= high_52w AND volume_spike >= 1.5 AND f.close > s.close",
    "Gap-and-Go": "s.bars >= 252 AND s.gap_pct > 2 AND s.close > s.open AND s.rsi_14 > 60 AND f.close > (s.open + s.pc) / 2",
    "BB Pierce Reversal": "s.bars >= 20 AND s.close < bb_lo AND s.rsi_14 <= 30 AND (s.hammer <> 0 OR s.engulfing <> 0) AND (f.engulfing <> 0 OR f.rsi_14 > 40)",
    "Over-extension Fade": "s.bars >= 20 AND atr_14 > 0 AND (s.close - ema_20) / atr_14 >= 2 AND s.rsi_14 > 75 AND f.bars > 1 AND f.high < p_high AND f.engulfing <> 0 AND f.volume < p_volume",
    "Hammer at SMA50": "s.bars >= 200 AND s.hammer = 1 AND f.inside_bar = 1 AND f.close > s.high AND abs(s.low - sma_50) / sma_50 < 0.01",
    "Hammer at SMA200": "s.bars >= 200 AND s.hammer = 1 AND f.inside_bar = 1 AND f.close > s.high AND NOT abs(s.low - sma_50) / sma_50 < 0.01 AND abs(s.low - sma_200) / sma_200 < 0.01",
    "Bullish Engulfing Reversal": "s.bars >= 200 AND s.engulfing <> 0 AND r5 < 0.7 * r20 AND f.bars > 5 AND os > 0 AND ps < 0 AND s.close > s.open",
}


def _alert_sql(pair: str) -> str:
    parts = " UNION ALL ".join(
        f"""SELECT s.ticker, s.ts, '{n}' AS pattern, '{A.RULES[n][0]}' AS action, '{A.RULES[n][1]}' AS risk_level,
 {'bb_mid' if n == 'BB Pierce Reversal' else 'NULL'} AS target, spike, obv_slope3, f.bars AS fb FROM {pair} WHERE {cond}""" for n, cond in _RULE_SQL.items())
    ok = "spike >= 1.3 AND (fb <= 2 OR (action LIKE 'BUY%' AND obv_slope3 > 0) OR (action NOT LIKE 'BUY%' AND obv_slope3 < 0))"
    return f"""WITH {Q.WEEKS}, {SLOW_SQL}, {FAST_SQL}, al AS ({parts}) SELECT ticker, ts, pattern, action, risk_level, round(target, 4) AS target,
 CASE WHEN {ok} THEN 1 ELSE 0 END AS volume_confirmed, CASE WHEN {ok} THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM al"""


_LAST_IN_WEEK = """(SELECT *, CAST(date_trunc('week', ts) AS TIMESTAMP) AS wk FROM fa QUALIFY row_number() OVER (PARTITION BY ticker, date_trunc('week', ts) ORDER BY ts DESC) = 1)"""


@query("alerts_history", _alert_sql(f"sl s JOIN {_LAST_IN_WEEK} f ON s.ticker = f.ticker AND s.ts = f.wk"))
def alerts_history(spark, sf):
    """Every week of every ticker against the rules (weekly trigger, cue of the week's last day)."""
    day = V.bars_1d(spark, sf)
    pairs = A.pair_history(A.slow_features(B.rollup_bars(day, "week"), 7 * S.DAY), A.fast_features(day, S.DAY), "week")
    return A.alerts(pairs).withColumn("target", r(c("target")))


@query("alerts_latest", _alert_sql("(SELECT * FROM sl QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) = 1) s JOIN "
                                   "(SELECT * FROM fa QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) = 1) f ON s.ticker = f.ticker"))
def alerts_latest(spark, sf):
    day = V.bars_1d(spark, sf)
    pairs = A.pair_latest(A.slow_features(B.rollup_bars(day, "week"), 7 * S.DAY), A.fast_features(day, S.DAY))
    return A.alerts(pairs).withColumn("target", r(c("target")))


# ------------------------------------------------------------------ strategies

_DAY = "PARTITION BY ticker, CAST(ts AS DATE)"
STRAT_SQL = f"""{SESSION_SQL.format(k=3)}, sx AS (SELECT *, {', '.join(f"max(CASE WHEN bar_no <= {k} THEN high END) OVER ({_DAY}) AS orh_{k}, min(CASE WHEN bar_no <= {k} THEN low END) OVER ({_DAY}) AS orl_{k}" for k in T.OPENING)},
 bar_no = max(bar_no) OVER ({_DAY}) AS last_bar FROM se), {Q.numbered('sx')}, {ADX_SQL},
 sg AS (SELECT *, {Q.mean('tr', 14)} AS atr, {Q.mean('volume', 20)} AS av, lag(low) {Q.ROW} AS p_low, min(low) {Q.over(10, 1)} AS low_10, min(low) {Q.over(15, 1)} AS low_15,
 {Q.mean(Q.GAIN, 14)} AS gu, {Q.mean(Q.LOSS, 14)} AS gv, {', '.join(f"{Q.ema('close', S.span(n), True)} AS ema_{n}" for n in (9, 20, 21))} FROM ax),
 sh AS (SELECT *, {Q.rsi('gu', 'gv')} AS rsi, hour(ts) + minute(ts) / 60.0 AS h, CASE WHEN r < 19 THEN 'unknown' WHEN adx > 30 THEN 'trending' WHEN adx < 20 THEN 'ranging'
 WHEN atr / nullif(close, 0) > 0.02 THEN 'volatile' WHEN atr / nullif(close, 0) < 0.01 THEN 'quiet' ELSE 'normal' END AS regime FROM sg)"""
_FIXED = [
    ("ORB", "bar_no > 30 AND pc <= orh_30 AND close > orh_30 AND volume > 1.5 * av", "orl_30", "close + 2 * (close - orl_30)", "75"),
    ("VWAP_Bounce", "r >= 20 AND abs(close - session_vwap) < 0.2 * atr AND low <= session_vwap AND close > session_vwap AND rsi > 40 AND rsi < 60", "session_vwap - 0.5 * atr", "close + 1.5 * atr", "80"),
    ("EMA_Pullback", "r >= 20 AND ema_9 > ema_20 AND ema_20 > session_vwap AND p_low <= ema_20 AND close > ema_9 AND volume > 1.3 * av", "ema_20 - 0.3 * atr", "close + 1.5 * atr", "82"),
    ("Support_Bounce", "r >= 10 AND low <= low_10 * 1.001 AND close > low + 0.6 * (high - low) AND rsi < 40", "low_10 - 0.2 * atr", "close + 2 * atr", "78"),
]
_CONF = "least(95, 50 + CASE WHEN volume / nullif(av, 0) > 2 THEN 15 WHEN volume / nullif(av, 0) > 1.5 THEN 10 WHEN volume / nullif(av, 0) > 1.2 THEN 5 ELSE 0 END + CASE WHEN ema_9 > ema_21 THEN 5 ELSE 0 END{x})"
_TR = " + CASE WHEN regime = 'trending' THEN 10 ELSE 0 END"


def _rg(vol, quiet, other):
    return f"CASE regime WHEN 'volatile' THEN {vol} WHEN 'quiet' THEN {quiet} ELSE {other} END"


_ORH, _ORL = _rg("orh_45", "orh_20", "orh_30"), _rg("orl_45", "orl_20", "orl_30")
_V = "CASE WHEN regime = 'volatile' THEN {a} ELSE {b} END"
_FLEX = [
    ("ORB_Flexible", f"bar_no > {_rg(45, 20, 30)} AND (({_ORH}) - ({_ORL})) / nullif({_ORL}, 0) >= {_rg(0.008, 0.003, 0.005)} AND pc <= {_ORH} AND close > ({_ORH}) + CASE WHEN atr IS NULL THEN ({_ORH}) * 0.0003 ELSE greatest(({_ORH}) * 0.0003, atr * 0.1) END AND volume > av * ({TVM_SQL.format(base='(' + _rg(1.3, 2.0, 1.5) + ')')})",
     f"close - greatest(({_ORH}) - ({_ORL}), 0.5 * atr)", f"close + 2 * greatest(({_ORH}) - ({_ORL}), 0.5 * atr)", _CONF.format(x=" + CASE WHEN h >= 10 AND h <= 11 THEN 10 ELSE 0 END" + _TR)),
    ("VWAP_Bounce_Flexible", f"r >= 20 AND abs(close - session_vwap) < ({_V.format(a=0.3, b=0.2)}) * atr AND low <= session_vwap AND close > session_vwap AND rsi > {_V.format(a=35, b=40)} AND rsi < {_V.format(a=65, b=60)} AND h < 15.5",
     "session_vwap - 0.5 * atr", "close + 1.5 * atr * CASE WHEN h > 14.5 THEN 0.7 ELSE 1.0 END", _CONF.format(x=" + CASE WHEN regime = 'ranging' THEN 10 ELSE 0 END")),
    ("EMA_Pullback_Flexible", f"r >= 20 AND ema_9 > ema_21 AND ema_21 > session_vwap AND p_low <= ema_21 AND close > ema_9 AND ema_21 - p_low <= atr * CASE WHEN regime = 'trending' THEN 0.7 ELSE 0.5 END AND volume > av * ({TVM_SQL.format(base=chr(40) + 'CASE WHEN regime = ' + chr(39) + 'trending' + chr(39) + ' THEN 1.2 ELSE 1.3 END' + chr(41))})",
     "ema_21 - 0.3 * atr", "close + 1.5 * atr", _CONF.format(x=" + CASE WHEN h >= 14 AND h <= 15 THEN 10 ELSE 0 END" + _TR)),
    ("Support_Bounce_Flexible", f"r >= 10 AND abs(low - ({_V.format(a='low_15', b='low_10')})) < atr * ({_V.format(a=0.3, b=0.2)}) AND (close - low) / nullif(high - low, 0) > 0.6 AND rsi < {_V.format(a=35, b=40)} AND h >= 9.75",
     f"({_V.format(a='low_15', b='low_10')}) - 0.2 * atr", "close + 2 * atr", _CONF.format(x="")),
]


def _strat_sql(rules):
    return "st AS (" + " UNION ALL ".join(
        f"SELECT ticker, ts, regime, last_bar, '{n}' AS strategy, close AS entry, {stop} AS stop, {tgt} AS target, CAST({conf} AS DOUBLE) AS confidence, {i} AS prio FROM sh WHERE {cond}"
        for i, (n, cond, stop, tgt, conf) in enumerate(rules)) + ")"


_SCOLS = "ticker, ts, regime, strategy, round(entry, 4) AS entry, round(stop, 4) AS stop, round(target, 4) AS target, confidence"


def _show(df):
    return df.select("ticker", "ts", *(["regime"] if "regime" in df.columns else []), "strategy", *[r(c(x)).alias(x) for x in ("entry", "stop", "target")], "confidence")


@query("strategy_fixed", f"WITH {Q.BARS_15M}, {STRAT_SQL}, {_strat_sql(_FIXED)} SELECT {_SCOLS} FROM st")
def strategy_fixed(spark, sf):
    return _show(T.signals(T.features(V.bars_15m(spark, sf)), T.fixed_rules()))


@query("strategy_flexible", f"WITH {Q.BARS_15M}, {STRAT_SQL}, {_strat_sql(_FLEX)} SELECT {_SCOLS} FROM st")
def strategy_flexible(spark, sf):
    return _show(T.signals(T.features(V.bars_15m(spark, sf)), T.flexible_rules()))


@query("strategy_first_match", f"""WITH {Q.BARS_15M}, {STRAT_SQL}, {_strat_sql(_FIXED)} SELECT {_SCOLS.replace('regime, ', '')} FROM (SELECT * FROM st WHERE last_bar AND confidence >= 78
 QUALIFY row_number() OVER (PARTITION BY ticker, CAST(ts AS DATE) ORDER BY prio) = 1)""")
def strategy_first_match(spark, sf):
    return _show(T.first_match(T.features(V.bars_15m(spark, sf)), T.fixed_rules()))


@query("strategy_once_per_day", f"""WITH {Q.BARS_15M}, {STRAT_SQL}, {_strat_sql(_FIXED)} SELECT {_SCOLS} FROM st
 QUALIFY row_number() OVER (PARTITION BY ticker, strategy, CAST(ts AS DATE) ORDER BY ts) = 1""")
def strategy_once_per_day(spark, sf):
    return _show(T.once_per_day(T.signals(T.features(V.bars_15m(spark, sf)), T.fixed_rules())))
