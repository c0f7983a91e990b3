"""Outcome evaluation and text mentions: queries and their SQL."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from barflow.functions.scalar import r
from barflow.operators import evaluate as V2, indicators as I, mentions as M, series as S
from barflow.plans import sql as Q
from barflow.plans.indicator_queries import sel
from barflow.plans.registry import query
from barflow.session import cut_lineage
from barflow.sources import views as V

c = F.col
_DIR = "CASE WHEN close > open THEN 'bullish' WHEN close < open THEN 'bearish' ELSE 'neutral' END"
_O = "PARTITION BY ticker ORDER BY ts RANGE BETWEEN INTERVAL '1 microsecond' FOLLOWING AND INTERVAL '{k} seconds' FOLLOWING"
_E = "PARTITION BY ticker, CAST(ts AS DATE) ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"


def _outcome_sql(strict=False, threshold="0.1", neutral="NULL"):
    parts = []
    for n, k in (("5min", 300), ("15min", 900), ("30min", 1800), ("1hour", 3600), ("2hour", 7200), ("eod", None)):
        o = _E if k is None else _O.format(k=k)
        ok = f"max(ts) OVER (PARTITION BY ticker) >= ts + INTERVAL '{k} seconds'" if strict and k else "TRUE"
        parts.append(f"SELECT ticker, ts, direction, price, '{n}' AS horizon, CASE WHEN ok THEN fin END AS fin, CASE WHEN ok THEN hi END AS hi, CASE WHEN ok THEN lo END AS lo, atr FROM (SELECT *, {ok} AS ok, last(close) OVER ({o}) AS fin, max(high) OVER ({o}) AS hi, min(low) OVER ({o}) AS lo FROM ev0)")
    return f"""{Q.numbered()}, e1 AS (SELECT *, {Q.TR} AS tr FROM s), ev0 AS (SELECT *, {_DIR} AS direction, close AS price, {Q.ema('tr', S.wilder(14))} AS atr FROM e1), u AS ({' UNION ALL '.join(parts)}),
 u1 AS (SELECT *, (fin - price) / nullif(price, 0) * 100 AS change, (hi - price) / nullif(price, 0) * 100 AS up, (price - lo) / nullif(price, 0) * 100 AS dn, {threshold} AS th FROM u),
 oc AS (SELECT *, CASE direction WHEN 'bullish' THEN up WHEN 'bearish' THEN dn ELSE abs(change) END AS mf, CASE WHEN fin IS NOT NULL THEN CASE direction WHEN 'bullish' THEN dn WHEN 'bearish' THEN up ELSE 0 END END AS ma,
 CASE WHEN fin IS NOT NULL THEN CASE direction WHEN 'bullish' THEN CASE WHEN change > th THEN 1 ELSE 0 END WHEN 'bearish' THEN CASE WHEN change < -th THEN 1 ELSE 0 END ELSE {neutral} END END AS success FROM u1)"""


def _events(spark, sf, strict=False):
    df = V2.add_futures(V.bars_15m(spark, sf), 900, strict)
    d = F.when(c("close") > c("open"), "bullish").when(c("close") < c("open"), "bearish").otherwise("neutral")
    return df.withColumns({"direction": d, "price": c("close")})


_OUT = sel(change="change", max_favorable="mf", max_adverse="ma", final="fin")


@query("eval_pattern_outcomes", f"WITH {Q.BARS_15M}, {_outcome_sql()} SELECT ticker, ts, horizon, direction, success, {_OUT} FROM oc")
def eval_pattern_outcomes(spark, sf):
    o = V2.pattern_outcomes(_events(spark, sf))
    return o.select("ticker", "ts", "horizon", "direction", "success", *[r(c(x)).alias(x) for x in ("change", "max_favorable", "max_adverse", "final")])


@query("eval_pattern_strict", f"WITH {Q.BARS_15M}, {_outcome_sql(True, 'greatest(atr / nullif(price, 0) * 100 * 0.25, 0.1)', 'CASE WHEN abs(change) <= th THEN 1 ELSE 0 END')} SELECT ticker, ts, horizon, direction, success, {_OUT} FROM oc WHERE horizon <> 'eod'")
def eval_pattern_strict(spark, sf):
    atr = S.unblock(S.ewm(I.add_change(S.blocked(V.bars_15m(spark, sf), 900)), {"atr": (c("tr"), S.wilder(14), False)})).select("ticker", "ts", "atr")
    e = _events(spark, sf, True).join(atr, ["ticker", "ts"])
    e = e.withColumn("th", F.greatest(F.try_divide(c("atr"), c("price")) * 100 * 0.25, F.lit(0.1)))
    o = V2.pattern_outcomes(e, c("th"), True).filter(c("horizon") != "eod")
    return o.select("ticker", "ts", "horizon", "direction", "success", *[r(c(x)).alias(x) for x in ("change", "max_favorable", "max_adverse", "final")])


@query("eval_win_rates", f"""WITH {Q.BARS_15M}, {_outcome_sql()} SELECT horizon, direction, count(fin) AS total, count(*) - count(fin) AS open, round(coalesce(avg(success) * 100, 0), 4) AS win_rate, round(avg(change), 4) AS avg_change, round(avg(mf), 4) AS avg_favorable,
 round(avg(ma), 4) AS avg_adverse FROM oc GROUP BY 1, 2""")
def eval_win_rates(spark, sf):
    w = V2.win_rates(V2.pattern_outcomes(_events(spark, sf)), ["horizon", "direction"])
    return w.select("horizon", "direction", "total", "open", *[r(c(x)).alias(x) for x in ("win_rate", "avg_change", "avg_favorable", "avg_adverse")])


_TRADES = f"""tr AS (SELECT ticker, ts, CASE WHEN close >= open THEN 'BUY' ELSE 'SELL' END AS action, close * CASE WHEN close >= open THEN 1.05 ELSE 0.95 END AS entry, close * CASE WHEN close >= open THEN 0.8 ELSE 1.2 END AS sl,
 close * CASE WHEN close >= open THEN 1.5 ELSE 0.5 END AS tg FROM b),
 f AS (SELECT t.*, x.ts AS xt, x.high, x.low FROM tr t JOIN b x ON x.ticker = t.ticker AND x.ts > t.ts),
 g AS (SELECT ticker, ts, min(xt) AS trig FROM f WHERE (action = 'BUY' AND high >= entry) OR (action = 'SELL' AND low <= entry) GROUP BY 1, 2),
 h AS (SELECT f.ticker, f.ts, min(xt) FILTER ((action = 'BUY' AND low <= sl) OR (action = 'SELL' AND high >= sl)) AS st, min(xt) FILTER ((action = 'BUY' AND high >= tg) OR (action = 'SELL' AND low <= tg)) AS gt FROM f JOIN g ON f.ticker = g.ticker AND f.ts = g.ts WHERE xt >= trig GROUP BY 1, 2),
 to_ AS (SELECT tr.*, trig, CASE WHEN trig IS NULL THEN CASE WHEN (SELECT max(ts) FROM b) - tr.ts > INTERVAL '1 day' THEN 'expired' ELSE 'pending' END WHEN st IS NOT NULL AND (gt IS NULL OR st <= gt) THEN 'hit_stop' WHEN gt IS NOT NULL THEN 'hit_target' ELSE 'triggered' END AS status
 FROM tr LEFT JOIN g ON tr.ticker = g.ticker AND tr.ts = g.ts LEFT JOIN h ON tr.ticker = h.ticker AND tr.ts = h.ts)"""


def _trades(spark, sf):
    """Every bar as a trade, followed to the end of the history."""
    b = V.bars_1d(spark, sf)
    up = c("close") >= c("open")
    t = b.select("ticker", "ts", F.when(up, "BUY").otherwise("SELL").alias("action"), (c("close") * F.when(up, 1.05).otherwise(0.95)).alias("entry"),
                 (c("close") * F.when(up, 0.8).otherwise(1.2)).alias("stop_loss"), (c("close") * F.when(up, 1.5).otherwise(0.5)).alias("target"))
    t = t.crossJoin(F.broadcast(b.agg(F.max("ts").alias("now"))))
    return V2.trade_outcomes(t, b, c("now"))


@query("eval_trade_outcomes", f"WITH {Q.BARS}, {_TRADES} SELECT ticker, ts, action, trig AS trigger_ts, status FROM to_")
def eval_trade_outcomes(spark, sf):
    return _trades(spark, sf).select("ticker", "ts", "action", "trigger_ts", "status")


@query("eval_tracker_summary", f"""WITH {Q.BARS}, {_TRADES}, k AS (SELECT ticker, count(*) AS total, {', '.join(f"count(*) FILTER (status = '{x}') AS {x}" for x in ('pending', 'triggered', 'hit_target', 'hit_stop', 'expired'))} FROM to_ GROUP BY 1)
 SELECT *, round(coalesce(hit_target * 100.0 / nullif(hit_target + hit_stop, 0), 0), 4) AS win_rate FROM k""")
def eval_tracker_summary(spark, sf):
    return V2.tracker_summary(_trades(spark, sf)).withColumn("win_rate", r(c("win_rate")))


_DR = "CASE WHEN {x} > 2 THEN 'BULLISH' WHEN {x} < -2 THEN 'BEARISH' ELSE 'NEUTRAL' END"
_FE = f"""p0 AS (SELECT ticker, ts, close AS price, (close / nullif(lag(close, 4) {Q.ROW}, 0) - 1) * 100 AS pp FROM b), p1 AS (SELECT *, {_DR.format(x='pp')} AS direction FROM p0 WHERE pp IS NOT NULL),
 t3 AS (SELECT *, '1h' AS horizon, ts + INTERVAL '1 hour' AS tgt FROM p1 UNION ALL SELECT *, '3h', ts + INTERVAL '3 hours' FROM p1 UNION ALL SELECT *, 'eod', date_trunc('day', ts) + INTERVAL '16 hours' FROM p1),
 fe0 AS (SELECT t3.*, (b.close - price) / nullif(price, 0) * 100 AS ap FROM t3 ASOF LEFT JOIN b ON t3.ticker = b.ticker AND t3.tgt <= b.ts), fe AS (SELECT *, CASE WHEN ap IS NOT NULL THEN {_DR.format(x='ap')} END AS ad, CASE WHEN ap IS NOT NULL THEN CASE WHEN direction = {_DR.format(x='ap')} THEN 1 ELSE 0 END END AS ok, abs(pp - ap) AS err FROM fe0)"""


def _evals(spark, sf):
    b = V.bars_15m(spark, sf)
    p = S.blocked(b, 900)
    p = S.unblock(p.withColumn("pred_pct", (F.try_divide(c("close"), S.lag("close", 4)) - 1) * 100)).filter(c("pred_pct").isNotNull())
    p = p.select("ticker", "ts", c("close").alias("price"), "pred_pct", F.when(c("pred_pct") > 2, "BULLISH").when(c("pred_pct") < -2, "BEARISH").otherwise("NEUTRAL").alias("direction"))
    return V2.forecast_evaluation(p, b, 2.0)


@query("eval_forecasts", f"WITH {Q.BARS_15M}, {_FE} SELECT ticker, ts, horizon, direction, ad AS actual_direction, ok AS correct, round(ap, 4) AS actual_pct, round(err, 4) AS error FROM fe")
def eval_forecasts(spark, sf):
    return _evals(spark, sf).select("ticker", "ts", "horizon", "direction", "actual_direction", "correct", r(c("actual_pct")).alias("actual_pct"), r(c("error")).alias("error"))


_ACC = "ac AS (SELECT ticker, horizon, count(ok) AS total, count(*) - count(ok) AS open, avg(ok) * 100 AS accuracy, avg(err) AS avg_error, min(err) AS min_error, max(err) AS max_error, " + ", ".join(
    f"coalesce(avg(ok) FILTER (direction = '{d}') * 100, 0) AS {d.lower()}_accuracy" for d in ("BULLISH", "BEARISH", "NEUTRAL")) + " FROM fe GROUP BY 1, 2)"
_AC = ("accuracy", "avg_error", "min_error", "max_error", "bullish_accuracy", "bearish_accuracy", "neutral_accuracy")


@query("eval_accuracy", f"WITH {Q.BARS_15M}, {_FE}, {_ACC} SELECT ticker, horizon, total, open, {sel(**{x: x for x in _AC})} FROM ac")
def eval_accuracy(spark, sf):
    return V2.accuracy(_evals(spark, sf)).select("ticker", "horizon", "total", "open", *[r(c(x)).alias(x) for x in _AC])


@query("eval_rating", f"""WITH {Q.BARS_15M}, {_FE}, {_ACC}, q AS (SELECT ticker, avg(accuracy) AS o, last(horizon ORDER BY accuracy, horizon) AS best FROM ac GROUP BY 1) SELECT ticker, round(o, 4) AS overall, best AS best_horizon,
 CASE WHEN o >= 50 THEN 'EXCELLENT' WHEN o >= 45 THEN 'GOOD' WHEN o >= 40 THEN 'FAIR' ELSE 'NEEDS_IMPROVEMENT' END AS rating FROM q""")
def eval_rating(spark, sf):
    return V2.rating(V2.accuracy(_evals(spark, sf))).withColumn("overall", r(c("overall")))


@query("eval_trend", f"""WITH {Q.BARS_15M}, {_FE}, d AS (SELECT ticker, horizon, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ts, avg(ok) * 100 AS accuracy FROM fe WHERE ok IS NOT NULL GROUP BY 1, 2, 3), l AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY ticker, horizon ORDER BY ts DESC) <= 5),
 g AS (SELECT ticker, horizon, arg_min(accuracy, ts) AS f0, arg_max(accuracy, ts) AS f1, count(*) AS n FROM l GROUP BY 1, 2) SELECT ticker, horizon, round(f0, 4) AS first, round(f1, 4) AS last, n, CASE WHEN n < 2 THEN 'stable' WHEN f1 > f0 + 2 THEN 'improving' WHEN f1 < f0 - 2 THEN 'declining' ELSE 'stable' END AS trend FROM g""")
def eval_trend(spark, sf):
    d = _evals(spark, sf).filter("correct IS NOT NULL").groupBy("ticker", "horizon", F.date_trunc("day", "ts").alias("ts")).agg((F.avg("correct") * 100).alias("accuracy"))
    return V2.performance_trend(d).withColumns({"first": r(c("first")), "last": r(c("last"))})


@query("eval_flatten_metrics", f"WITH {Q.BARS_15M}, {_FE}, {_ACC} SELECT ticker, horizon, 'accuracy' AS metric, round(accuracy, 4) AS value FROM ac UNION ALL SELECT ticker, horizon, 'avg_error', round(avg_error, 4) FROM ac")
def eval_flatten_metrics(spark, sf):
    a = V2.accuracy(_evals(spark, sf)).groupBy("ticker").agg(F.map_from_entries(F.collect_list(F.struct("horizon", F.create_map(
        F.lit("accuracy"), r(c("accuracy")), F.lit("avg_error"), r(c("avg_error")))))).alias("metrics"))
    return V2.flatten_metrics(a)


@query("eval_recommendations", f"""WITH {Q.BARS_15M}, q AS (SELECT ticker, ts, close AS price, CASE WHEN close > open THEN 'BUY' WHEN close < open THEN 'SELL' ELSE 'HOLD' END AS rec FROM b),
 j AS (SELECT q.ticker, rec, (b.close - price) / nullif(price, 0) * 100 AS ch FROM q ASOF LEFT JOIN b ON q.ticker = b.ticker AND q.ts + INTERVAL '1 hour' <= b.ts), k AS (SELECT *, CASE WHEN ch IS NOT NULL THEN CASE WHEN (rec = 'BUY' AND ch > 1) OR (rec = 'SELL' AND ch < -1) OR (rec = 'HOLD' AND abs(ch) <= 1) THEN 1 ELSE 0 END END AS ok FROM j)
 SELECT ticker, count(ok) AS total, count(*) - count(ok) AS open, CAST(sum(ok) AS BIGINT) AS correct, round(avg(ok) * 100, 4) AS accuracy, round(avg(ch), 4) AS avg_change, {', '.join(f"round(coalesce(avg(ok) FILTER (rec = '{x.upper()}') * 100, 0), 4) AS {x}_accuracy, count(*) FILTER (rec = '{x.upper()}' AND ok IS NOT NULL) AS {x}_count" for x in ('buy', 'sell', 'hold'))} FROM k GROUP BY 1""")
def eval_recommendations(spark, sf):
    b = V.bars_15m(spark, sf)
    q = b.select("ticker", "ts", c("close").alias("price"), F.when(c("close") > c("open"), "BUY").when(c("close") < c("open"), "SELL").otherwise("HOLD").alias("recommendation"))
    g = V2.recommendation_report(q, b, 1, 1.0)
    return g.withColumns({x: r(c(x)) for x in ("accuracy", "avg_change", "buy_accuracy", "sell_accuracy", "hold_accuracy")})


@query("eval_walk_forward", f"""WITH {Q.BARS}, w0 AS (SELECT ticker, ts, close / nullif(lag(close, 5) {Q.ROW}, 0) - 1 AS f, lead(close) {Q.ROW} / nullif(close, 0) - 1 AS nr, lead(ts) {Q.ROW} AS nts, min(ts) OVER (PARTITION BY ticker) AS t0 FROM b),
 w1 AS (SELECT *, CAST(floor((date_diff('day', t0, ts) - 60) / 20.0) AS INTEGER) AS split, date_diff('day', t0, nts) AS nd FROM w0), sp AS (SELECT DISTINCT ticker, split FROM w1 WHERE split >= 0),
 rl AS (SELECT sp.ticker, sp.split, CASE WHEN max(f) > min(f) THEN regr_slope(nr, f) END AS slope, avg(nr) AS my, avg(f) AS mx FROM sp JOIN w1 ON w1.ticker = sp.ticker AND f IS NOT NULL AND nr IS NOT NULL AND nd >= 60 + 20 * sp.split - 90 AND nd < 60 + 20 * sp.split GROUP BY 1, 2),
 w2 AS (SELECT w1.*, my + slope * (f - mx) AS promise FROM w1 LEFT JOIN rl USING (ticker, split) WHERE w1.split >= 0 AND nr IS NOT NULL), w3 AS (SELECT *, CASE WHEN promise > 0.001 THEN 1 WHEN promise < -0.001 THEN -1 ELSE 0 END AS sg FROM w2),
 w4 AS (SELECT *, greatest(sg * nr - abs(sg - coalesce(lag(sg) OVER (PARTITION BY ticker, split ORDER BY ts), 0)) * 0.001, -1.0 + 1e-12) AS sr FROM w3), w5 AS (SELECT *, exp(sum(ln(1 + sr)) OVER (PARTITION BY ticker, split ORDER BY ts)) AS eq FROM w4),
 w6 AS (SELECT *, eq / greatest(1.0, max(eq) OVER (PARTITION BY ticker, split ORDER BY ts)) - 1 AS dd FROM w5)
 SELECT ticker, split, count(*) AS bars, count(*) FILTER (sg <> 0) AS trades, round(exp(sum(ln(1 + sr))) - 1, 4) AS total_return, round(avg(sr) / nullif(stddev_samp(sr), 0) * sqrt(252.0), 4) AS sharpe, round(min(dd), 4) AS max_drawdown,
 round(avg(CASE WHEN sr > 0 THEN 1 ELSE 0 END) FILTER (sg <> 0), 4) AS win_rate, round(sum(CASE WHEN sr > 0 THEN sr ELSE 0 END) / nullif(sum(CASE WHEN sr < 0 THEN -sr ELSE 0 END), 0), 4) AS profit_factor FROM w6 GROUP BY 1, 2""")
def eval_walk_forward(spark, sf):
    df = S.blocked(V.bars_1d(spark, sf))
    df = df.withColumns({"feature": F.try_divide(c("close"), S.lag("close", 5)) - 1, "next_ret": F.try_divide(S.lead("close"), c("close")) - 1, "next_ts": S.lead("ts")})
    if S.one_block(df):
        df = df.withColumn("first_ts", F.min("ts").over(Window.partitionBy("ticker", S.BLK)))
    rows = S.unblock(df).drop("open", "high", "low", "close", "volume")
    g = V2.walk_forward(V2.fitted_signals(rows, 90, 20, 60, 0.001), 0.001)
    return g.withColumns({x: r(c(x)) for x in ("total_return", "sharpe", "max_drawdown", "win_rate", "profit_factor")})


@query("eval_sampled_backtest", f"""WITH {Q.BARS_15M}, {Q.numbered()}, z AS (SELECT *, (close / nullif(lag(close, 4) {Q.ROW}, 0) - 1) * 100 AS p, (lead(close, 4) {Q.ROW} / nullif(close, 0) - 1) * 100 AS a1, (lead(close, 12) {Q.ROW} / nullif(close, 0) - 1) * 100 AS a3 FROM s)
 SELECT ticker, ts, {sel(pred_pct='p', actual_1h='a1', actual_3h='a3')} FROM z WHERE r % 7 = 0 AND p IS NOT NULL""")
def eval_sampled_backtest(spark, sf):
    return V2.sampled_backtest(V.bars_15m(spark, sf), 7).select("ticker", "ts", *[r(c(x)).alias(x) for x in ("pred_pct", "actual_1h", "actual_3h")])


@query("eval_latest_prediction", """SELECT ticker, ts, event_id FROM (SELECT event_type AS ticker, ts, event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL '6 hours') QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, event_id DESC) = 1""")
def eval_latest_prediction(spark, sf):
    return V2.latest_within(V.table(spark, sf, "events").select(c("event_type").alias("ticker"), "ts", "event_id"), 6)


# ------------------------------------------------------------------ mentions

UNIVERSE = ["CI", "DE", "LA", "DER", "EN", "OU", "QUE", "LE", "ERHE", "UNE"]
LEX = {"the": 0.1, "was": -0.25, "that": 0.5, "with": 0.25, "der": -0.5, "que": 0.75, "for": -0.125, "les": 0.5}
_UNI = ", ".join(f"('{x}')" for x in UNIVERSE)
_CT = r"trim(regexp_replace(regexp_replace(text, '[\x00-\x1F\x7F]+', ' ', 'g'), ' +', ' ', 'g'), ' ')"
_CASE = " + ".join(f"len(list_filter(w, lambda x: x = '{k}')) * {v}" for k, v in LEX.items())
_NUM = " + ".join(f"len(list_filter(w, lambda x: x = '{k}'))" for k in LEX)
_SL = " + ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN {w} ELSE 0 END" for p, w in M.SLANG)
MEN_SQL = f"""{Q.POSTS}, m0 AS (SELECT * REPLACE ({_CT} AS text) FROM p), m1 AS (SELECT *, regexp_replace(text, '[À-ÖØ-öø-ÿ]', '_', 'g') AS ft, regexp_extract_all(lower(text), '[a-z]+') AS w, greatest(score + num_comments, 0) AS engagement, CASE WHEN score >= 500 THEN 1 ELSE 0 END AS influencer FROM m0),
 m2 AS (SELECT *, coalesce(({_CASE}) / nullif({_NUM}, 0), 0) + {_SL} AS sent FROM m1),
 m3 AS (SELECT *, unnest(list_distinct(list_concat(list_transform(regexp_extract_all(ft, '\\$[A-Z]{{1,5}}\\b'), lambda x: replace(x, '$', '')), regexp_extract_all(ft, '\\b[A-Z]{{1,5}}\\.TO\\b'), list_filter(regexp_extract_all(ft, '\\b[A-Z]{{2,5}}\\b'), lambda x: list_contains({UNIVERSE!r}, x))))) AS ticker FROM m2)"""


def _universe(spark):
    return spark.createDataFrame([(x,) for x in UNIVERSE], "ticker string")


def _mentions(spark, sf):
    """Mentions, written once to the shared folder: several aggregates follow and the text must not be read again."""
    return cut_lineage(M.extract(M.prepare(V.posts(spark, sf), LEX), _universe(spark)))


@query("text_mentions", f"WITH {MEN_SQL} SELECT ticker, url, created_utc, engagement, influencer, round(sent, 4) AS sent FROM m3")
def text_mentions(spark, sf):
    return _mentions(spark, sf).select("ticker", "url", "created_utc", "engagement", "influencer", r(c("sent")).alias("sent"))


@query("text_sentiment", f"WITH {MEN_SQL} SELECT url, round(sent, 4) AS sent, engagement, influencer FROM m2")
def text_sentiment(spark, sf):
    return M.prepare(V.posts(spark, sf), LEX).select("url", r(c("sent")).alias("sent"), "engagement", "influencer")


_STR = ", ".join(f"regexp_extract_all(u, '{p}', 1)" for p in M.PHRASES)


@query("text_strict_mentions", f"""WITH {Q.POSTS}, a AS (SELECT *, upper(regexp_replace('sold ' || author || ' calls. ' || text, '[À-ÖØ-öø-ÿ]', '_', 'g')) AS u FROM p), x AS (SELECT url, unnest(list_distinct(flatten([{_STR}]))) AS ticker FROM a)
 SELECT ticker, count(*) AS posts FROM x WHERE ticker IN ({', '.join(repr(x) for x in UNIVERSE + ['THE', 'AND', 'THAT', 'WITH', 'PO', 'SH', 'TH'])}) GROUP BY 1""")
def text_strict_mentions(spark, sf):
    uni = spark.createDataFrame([(x,) for x in UNIVERSE + ["THE", "AND", "THAT", "WITH", "PO", "SH", "TH"]], "ticker string")
    posts = V.posts(spark, sf).withColumn("text", F.concat(F.lit("sold "), c("author"), F.lit(" calls. "), c("text")))
    return M.extract_strict(posts, uni).groupBy("ticker").agg(F.count(F.lit(1)).alias("posts"))


HOUR_SQL = f"""{MEN_SQL}, hf AS (SELECT ticker, date_trunc('hour', created_utc) AS hour_utc, count(*) AS mentions, avg(sent) AS sent_avg, median(sent) AS sent_med, sum(engagement) AS engagement_sum, CAST(sum(influencer) AS BIGINT) AS influencers FROM m3 GROUP BY 1, 2)"""


@query("text_hourly_features", f"WITH {HOUR_SQL} SELECT ticker, hour_utc, mentions, round(sent_avg, 4) AS sent_avg, round(sent_med, 4) AS sent_med, engagement_sum, influencers FROM hf")
def text_hourly_features(spark, sf):
    return M.hourly_features(_mentions(spark, sf)).withColumns({"sent_avg": r(c("sent_avg")), "sent_med": r(c("sent_med"))}).select(
        "ticker", "hour_utc", "mentions", "sent_avg", "sent_med", "engagement_sum", "influencers")


def _rz(x):
    return f"""(SELECT ticker, CASE WHEN count(*) < 10 THEN 0 ELSE coalesce((arg_max({x}, hour_utc) - any_value(med)) / nullif(CASE WHEN median(abs({x} - med)) > 0 THEN 1.4826 * median(abs({x} - med)) ELSE stddev_samp({x}) END, 0), 0) END AS z
 FROM (SELECT h1.*, med FROM h1 JOIN (SELECT ticker, median({x}) AS med FROM h1 GROUP BY 1) USING (ticker)) GROUP BY 1)"""


HYPE_SQL = f"""{HOUR_SQL}, h1 AS (SELECT * FROM (SELECT *, epoch((SELECT max(hour_utc) FROM hf) - hour_utc) / 3600.0 AS age FROM hf) WHERE age <= 191),
 h2 AS (SELECT ticker, CAST(sum(mentions) FILTER (age <= 23) AS BIGINT) AS m24, sum(sent_avg * greatest(1, mentions)) FILTER (age <= 23) / sum(greatest(1, mentions)) FILTER (age <= 23) AS s24, sum(engagement_sum) FILTER (age <= 23) AS e24,
 coalesce(avg(mentions) FILTER (age > 23) * 24, 0) AS mb, coalesce(avg(engagement_sum) FILTER (age > 23) * 24, 0) AS eb, count(*) FILTER (age <= 5) AS n6, count(*) FILTER (age <= 11 AND age > 5) AS p6, avg(sent_avg) FILTER (age <= 5) AS s6, avg(sent_avg) FILTER (age <= 11 AND age > 5) AS q6 FROM h1 GROUP BY 1),
 h3 AS (SELECT *, CASE WHEN n6 >= 2 AND p6 >= 2 THEN coalesce(s6 - q6, 0) ELSE 0 END AS momo, 100 * (m24 - mb) / greatest(mb, 5) AS mg, 100 * (e24 - eb) / greatest(eb, 50) AS eg FROM h2 WHERE m24 IS NOT NULL),
 h4 AS (SELECT h3.*, a.z AS ez, m.z AS mz, 0.35 * coalesce(3 * (mg - min(mg) OVER ()) / nullif(max(mg) OVER () - min(mg) OVER (), 0), 1.5) + 0.2 * s24 + 0.2 * momo AS hype FROM h3 LEFT JOIN {_rz('engagement_sum')} a USING (ticker) LEFT JOIN {_rz('mentions')} m USING (ticker))"""


@query("text_hype_index", f"WITH {HYPE_SQL} SELECT ticker, m24 AS mentions_24h, {sel(sent_24h='s24', mentions_growth='mg', engagement_growth='eg', sent_momo='momo', engagement_z='ez', mentions_z='mz', hype_index='hype')}, CASE WHEN m24 >= 10 AND mg >= 100 AND hype >= 1.2 THEN 1 ELSE 0 END AS alert FROM h4")
def text_hype_index(spark, sf):
    h = M.hype(cut_lineage(M.hourly_features(_mentions(spark, sf))))
    return h.select("ticker", "mentions_24h", *[r(c(x)).alias(x) for x in ("sent_24h", "mentions_growth", "engagement_growth", "sent_momo", "engagement_z", "mentions_z", "hype_index")], "alert")


@query("text_mention_summary", f"WITH {MEN_SQL} SELECT ticker, count(*) AS mentions, count(*) FILTER (type = 'post') AS posts, count(*) FILTER (type = 'comment') AS comments, count(DISTINCT subreddit) AS subreddits, round(avg(score), 4) AS avg_score FROM m3 GROUP BY 1")
def text_mention_summary(spark, sf):
    return M.mention_summary(_mentions(spark, sf)).withColumn("avg_score", r(c("avg_score")))


@query("text_trends", f"""WITH {HOUR_SQL}, d AS (SELECT ticker, CAST(hour_utc AS DATE) AS d, CAST(sum(mentions) AS BIGINT) AS daily FROM hf GROUP BY 1, 2), t AS (SELECT *, (SELECT max(d) FROM d) AS today FROM d),
 g AS (SELECT ticker, count(*) AS days_active, CAST(sum(daily) AS BIGINT) AS total, avg(daily) AS avg_daily, max(daily) AS max_daily, CAST(max(today - d) AS INTEGER) AS days_since_first, min(today - d) AS ago, CAST(coalesce(sum(daily) FILTER (d >= today - 2), 0) AS BIGINT) AS recent, CAST(coalesce(sum(daily) FILTER (d < today - 2), 0) AS BIGINT) AS earlier FROM t GROUP BY 1),
 k AS (SELECT *, CASE WHEN earlier > 0 THEN recent / earlier ELSE recent END AS m FROM g) SELECT ticker, days_active, total, max_daily, days_since_first, recent, earlier, round(m, 4) AS momentum, round(total * 0.3 + m * 10 + 20.0 / (ago + 1) + days_active * 2, 4) AS trend_score,
 CASE WHEN days_since_first <= 1 AND total >= 5 THEN 'NEW ENTRY' WHEN m > 3 AND total >= 10 THEN 'EXPLOSIVE' WHEN m > 1.5 AND days_active >= 3 THEN 'TRENDING UP' WHEN days_active >= 5 AND avg_daily >= 10 THEN 'SUSTAINED HEAT' WHEN m < 0.5 AND days_since_first > 3 THEN 'COOLING OFF' ELSE 'WATCHING' END AS category FROM k""")
def text_trends(spark, sf):
    t = M.trends(M.hourly_features(_mentions(spark, sf)).withColumn("ts", c("hour_utc")))
    return t.select("ticker", "days_active", "total", "max_daily", "days_since_first", "recent", "earlier", r(c("momentum")).alias("momentum"), r(c("trend_score")).alias("trend_score"), "category")


@query("text_strip_html", """SELECT page_id, md5(trim(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), ' ')) AS digest FROM pages""")
def text_strip_html(spark, sf):
    return V.pages(spark, sf).select("page_id", F.md5(M.strip_html(c("html"))).alias("digest"))


@query("text_message_fields", r"""SELECT doc_id, nullif(regexp_extract(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}'), '') AS address, nullif(regexp_extract(text, '\$[0-9,]+\.?[0-9]*'), '') AS amount, nullif(regexp_extract(text, 'Order #[0-9]+|Order Number: [0-9]+'), '') AS order_number FROM documents""")
def text_message_fields(spark, sf):
    f = M.message_fields(c("text"))
    return V.table(spark, sf, "documents").select("doc_id", *[f[k].alias(k) for k in ("address", "amount", "order_number")])
