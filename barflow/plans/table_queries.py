"""Cleaning, store maintenance, joins and aggregates: queries and their SQL."""
from __future__ import annotations


from pyspark.sql import Window, functions as F

from barflow.functions.scalar import div, r
from barflow.operators import clean as C, joins as J, series as S
from barflow.operators.quantiles import exact_quantiles
from barflow.plans import sql as Q
from barflow.plans.registry import query
from barflow.sources import views as V, writers as Wr

c = F.col
OHLC = ("open", "high", "low", "close")


def px(df, *extra):
    return df.select("ticker", "ts", *[r(c(x)).alias(x) for x in OHLC], "volume", *extra)


PX = "ticker, ts, " + ", ".join(f"round({x}, 4) AS {x}" for x in OHLC) + ", volume"


@query("clean_bar_columns", f"WITH {Q.BARS} SELECT {PX} FROM b WHERE volume <> 13")
def clean_bar_columns(spark, sf):
    """Bars with foreign names and one unreadable cell value -> normalised bars without the holes."""
    raw = V.bars_1d(spark, sf).select(
        c("ticker").alias("Symbol"), c("ts").alias("Datetime"), c("open").cast("string").alias("Open"), c("high").alias("High"),
        c("low").alias("Low"), c("close").alias("Adj Close"),
        F.when(c("volume") == 13, F.lit("n/a")).otherwise(c("volume").cast("string")).alias("Volume"))
    return px(C.normalise_bars(raw))


@query("clean_wide_to_long", """WITH e AS (SELECT date_trunc('hour', ts) AS ts, event_type AS ticker, max(value) AS close, sum(value) AS volume
 FROM events GROUP BY 1, 2)
 SELECT ticker, CAST(ts AS TIMESTAMP) AS ts, round(close, 4) AS close, round(volume, 4) AS volume FROM e""")
def clean_wide_to_long(spark, sf):
    e = V.table(spark, sf, "events")
    h = e.withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz")).groupBy("ts")
    wide = h.agg(*[f(F.when(c("event_type") == t, c("value"))).alias(f"{m}|{t}")
                   for t in ("click", "view", "error", "purchase", "signup") for m, f in (("Close", F.max), ("Volume", F.sum))])
    return C.wide_to_long(wide, ["close", "volume"]).select("ticker", "ts", r(c("close")).alias("close"), r(c("volume")).alias("volume"))


@query("clean_exchange_time", """SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-03-10 07:00:00' THEN ts - INTERVAL '4 hours'
 ELSE ts - INTERVAL '5 hours' END AS ny FROM events""")
def clean_exchange_time(spark, sf):
    return V.table(spark, sf, "events").select("event_id", C.to_exchange_time(c("ts")).alias("ny"))


_MIN = "(hour(ts) * 60 + minute(ts))"


@query("clean_session_status", f"""SELECT event_id, CASE WHEN {_MIN} BETWEEN 570 AND 960 AND dayofweek(ts) BETWEEN 1 AND 5 THEN 1 ELSE 0 END AS regular,
 CASE WHEN dayofweek(ts) IN (0, 6) THEN 'Weekend' WHEN {_MIN} < 570 THEN 'Pre-Market' WHEN {_MIN} <= 960 THEN 'Open' ELSE 'After-Hours' END AS status,
 CAST(CAST(d - CASE dayofweek(d) WHEN 0 THEN INTERVAL '2 days' WHEN 6 THEN INTERVAL '1 day' ELSE INTERVAL '0 days' END AS DATE) AS VARCHAR) AS trading_day
 FROM (SELECT *, CAST(ts AS DATE) - CASE WHEN {_MIN} < 570 THEN INTERVAL '1 day' ELSE INTERVAL '0 days' END AS d FROM events)""")
def clean_session_status(spark, sf):
    ts = c("ts")
    return V.table(spark, sf, "events").select("event_id", F.when(C.in_regular_session(ts), 1).otherwise(0).alias("regular"),
                                               C.market_status(ts).alias("status"),
                                               C.last_trading_day(ts).cast("string").alias("trading_day"))


@query("clean_recent_rows", f"WITH {Q.BARS} SELECT {PX} FROM b WHERE ts >= (SELECT max(ts) FROM b) - INTERVAL '90 days'")
def clean_recent_rows(spark, sf):
    return px(C.recent(V.bars_1d(spark, sf), 90))


@query("clean_latest_session", f"""WITH {Q.BARS_15M} SELECT {PX} FROM b QUALIFY CAST(ts AS DATE) = max(CAST(ts AS DATE)) OVER (PARTITION BY ticker)""")
def clean_latest_session(spark, sf):
    return px(C.latest_session(V.bars_15m(spark, sf)))


@query("clean_common_columns", f"WITH {Q.BARS} SELECT ticker, ts, round(close, 4) AS close FROM b UNION ALL SELECT ticker, ts, round(close, 4) FROM b WHERE volume > 40")
def clean_common_columns(spark, sf):
    b = V.bars_1d(spark, sf)
    other = b.filter(c("volume") > 40).select("close", "ts", "ticker", F.lit("x").alias("source"))
    return C.unify(b, other).select("ticker", "ts", r(c("close")).alias("close"))


@query("clean_distinct_posts", f"WITH {Q.POSTS} SELECT type, subreddit, count(*) AS posts FROM (SELECT type, arg_min(subreddit, subreddit) AS subreddit FROM p GROUP BY type, author, text) GROUP BY 1, 2")
def clean_distinct_posts(spark, sf):
    p = V.posts(spark, sf).withColumns({"url": c("author"), "created_utc": F.to_date(F.lit("2024-01-01"))})
    # posts of one author with one text count once; which subreddit such a post keeps is open, so the smallest is put beside it first
    least = p.groupBy("type", "url", "text").agg(F.min("subreddit").alias("subreddit"))
    twice = p.unionByName(p).drop("subreddit").join(least, ["type", "url", "text"])
    return C.distinct_posts(twice).groupBy("type", "subreddit").agg(F.count(F.lit(1)).alias("posts"))


@query("clean_parse_time", """SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts FROM events""")
def clean_parse_time(spark, sf):
    """Event times written in five formats (by id) and parsed back."""
    e = V.table(spark, sf, "events")
    t, k = F.date_trunc("second", "ts"), c("event_id") % 4
    text = (F.when(k == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format(t, "yyyy-MM-dd HH:mm:ss"))
            .when(k == 2, F.date_format(t, "M/d/yyyy HH:mm:ss")).otherwise(F.unix_seconds(t.cast("timestamp")).cast("string")))
    return e.select("event_id", C.parse_time(text).cast("timestamp_ntz").alias("ts"))


@query("clean_text", r"""SELECT doc_id, length(trim(regexp_replace(regexp_replace(text, '[\x00-\x1F\x7F]+', ' ', 'g'), ' +', ' ', 'g'), ' ')) AS n,
 md5(trim(regexp_replace(regexp_replace(text, '[\x00-\x1F\x7F]+', ' ', 'g'), ' +', ' ', 'g'), ' ')) AS digest FROM documents""")
def clean_text(spark, sf):
    d = V.table(spark, sf, "documents").withColumn("t", C.clean_text(c("text")))
    return d.select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


@query("clean_quality_report", f"""WITH {Q.BARS_15M}, dd AS (SELECT ticker, CAST(ts AS DATE) AS d, count(*) AS n, min(low) AS lo, max(high) AS hi, sum(volume) AS vol FROM b GROUP BY 1, 2)
 SELECT ticker, count(*) AS days, CAST(sum(n) AS BIGINT) AS bars, round(avg(n), 4) AS bars_per_day, min(n) AS min_per_day, max(n) AS max_per_day,
 count(*) FILTER (n >= 24) AS days_24, count(*) FILTER (n >= 25) AS days_25, count(*) FILTER (n >= 20) AS days_20, round(min(lo), 4) AS low, round(max(hi), 4) AS high,
 sum(vol) AS volume, CASE WHEN avg(n) >= 24 THEN 'EXCELLENT' WHEN avg(n) >= 20 THEN 'GOOD' ELSE 'SPARSE' END AS quality FROM dd GROUP BY 1""")
def clean_quality_report(spark, sf):
    q = C.quality_report(V.bars_15m(spark, sf))
    return q.select("ticker", "days", "bars", r(c("bars_per_day")).alias("bars_per_day"), "min_per_day", "max_per_day", "days_24", "days_25",
                    "days_20", r(c("low")).alias("low"), r(c("high")).alias("high"), "volume", "quality")


@query("clean_yearly_counts", f"""WITH {Q.BARS} SELECT coalesce(ticker, '*') AS ticker, CAST(coalesce(year(ts), -1) AS INTEGER) AS year, count(*) AS bars
 FROM b GROUP BY ROLLUP (ticker, year(ts))""")
def clean_yearly_counts(spark, sf):
    return C.yearly_counts(V.bars_1d(spark, sf))


@query("clean_enough_history", f"WITH {Q.BARS} SELECT ticker, count(*) AS bars FROM b GROUP BY 1 HAVING count(*) >= 530")
def clean_enough_history(spark, sf):
    return C.enough_history(V.bars_1d(spark, sf), 530).groupBy("ticker").agg(F.count(F.lit(1)).alias("bars"))


# ------------------------------------------------------------------ stores

@query("store_replace_days", f"""WITH {Q.BARS} SELECT {PX} FROM b WHERE ts < TIMESTAMP '2000-01-01' UNION ALL
 SELECT ticker, ts, round(open * 2, 4), round(high * 2, 4), round(low * 2, 4), round(close * 2, 4), volume FROM b WHERE ts >= TIMESTAMP '2000-01-01'""")
def store_replace_days(spark, sf):
    b = V.bars_1d(spark, sf)
    new = b.filter(c("ts") >= F.lit("2000-01-01").cast("timestamp_ntz")).withColumns({x: c(x) * 2 for x in OHLC})
    return px(Wr.replace_days(b, new))


@query("store_merge_latest", f"""WITH {Q.BARS} SELECT ticker, ts, round(CASE WHEN volume > 30 THEN close + 1 ELSE close END, 4) AS close FROM b""")
def store_merge_latest(spark, sf):
    b = V.bars_1d(spark, sf)
    new = b.filter(c("volume") > 30).withColumn("close", c("close") + 1)
    return Wr.merge_latest(b, new, ["ticker", "ts"]).select("ticker", "ts", r(c("close")).alias("close"))


@query("store_capped_log", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def store_capped_log(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", "ts", "event_type")
    old, new = e.filter(c("event_id") % 2 == 0), e.filter(c("event_id") % 2 == 1)
    return Wr.append_capped(old, new, 1000, [c("ts").desc(), c("event_id").desc()])


@query("store_insert_absent", """SELECT event_type AS ticker, date_trunc('hour', ts) AS hour_utc, CASE WHEN hour(ts) < 12 THEN 'old' ELSE 'new' END AS origin,
 count(*) AS mentions FROM events GROUP BY 1, 2, 3""")
def store_insert_absent(spark, sf):
    e = V.table(spark, sf, "events").withColumn("hour_utc", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    g = e.groupBy(c("event_type").alias("ticker"), "hour_utc").agg(F.count(F.lit(1)).alias("mentions"))
    store = g.filter(F.hour("hour_utc") < 12).withColumn("origin", F.lit("old"))
    return Wr.insert_absent(store, g.withColumn("origin", F.lit("new")), ["ticker", "hour_utc"]).select("ticker", "hour_utc", "origin", "mentions")


@query("store_retention", f"WITH {Q.BARS_1H} SELECT {PX} FROM b WHERE ts > (SELECT max(ts) FROM b) - INTERVAL '168 hours'")
def store_retention(spark, sf):
    return px(Wr.retain_hours(V.bars_1h(spark, sf), 168))


@query("log_newest_per_key", "SELECT event_type AS ticker, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 50")
def log_newest_per_key(spark, sf):
    e = V.table(spark, sf, "events").select(c("event_type").alias("ticker"), "event_id", "ts")
    return C.newest_n(e, 50, ["ticker"], [c("ts").desc(), c("event_id").desc()])


# ------------------------------------------------------------------ joins


def _signals(spark, sf):
    return V.bars_15m(spark, sf).select("ticker", "ts", c("close").alias("price"))


@query("join_asof_forward", f"""WITH {Q.BARS_15M} SELECT s.ticker, s.ts, b.ts AS hit_ts, round(b.close, 4) AS hit_close FROM b s ASOF LEFT JOIN b ON s.ticker = b.ticker AND s.ts + INTERVAL '1 hour' <= b.ts""")
def join_asof_forward(spark, sf):
    s = _signals(spark, sf).withColumn("target", c("ts") + F.expr("INTERVAL 1 HOUR"))
    return J.asof_join(s, V.bars_15m(spark, sf), "target", ["close"], "forward").select(
        "ticker", "ts", c("hit.ts").alias("hit_ts"), r(c("hit.close")).alias("hit_close"))


@query("join_asof_backward", f"""WITH {Q.BARS_1H.replace('b AS', 'b AS', 1)}, e AS (SELECT event_id, event_type AS ticker, ts FROM events)
 SELECT e.event_id, round(b.close, 4) AS close, b.ts AS bar_ts FROM e ASOF LEFT JOIN b ON e.ticker = b.ticker AND e.ts - INTERVAL '1 hour' >= b.ts""")
def join_asof_backward(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", c("event_type").alias("ticker"), (c("ts") - F.expr("INTERVAL 1 HOUR")).alias("at"))
    return J.asof_join(e, V.bars_1h(spark, sf), "at", ["close"], "backward", 3600).select(
        "event_id", r(c("hit.close")).alias("close"), c("hit.ts").alias("bar_ts"))


@query("join_asof_nearest", f"""WITH {Q.BARS_1H}, e AS (SELECT event_id, event_type AS ticker, ts FROM events),
 a AS (SELECT e.event_id, e.ticker, e.ts, b.ts AS t0 FROM e ASOF LEFT JOIN b ON e.ticker = b.ticker AND e.ts >= b.ts),
 z AS (SELECT a.*, b.ts AS t1 FROM a ASOF LEFT JOIN b ON a.ticker = b.ticker AND a.ts <= b.ts)
 SELECT event_id, CASE WHEN t1 IS NULL OR ts - t0 <= t1 - ts THEN t0 ELSE t1 END AS bar_ts FROM z""")
def join_asof_nearest(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", c("event_type").alias("ticker"), c("ts").alias("at"))
    return J.asof_join(e, V.bars_1h(spark, sf), "at", ["close"], "nearest", 3600).select("event_id", c("hit.ts").alias("bar_ts"))


@query("join_range_after", f"""WITH {Q.BARS} SELECT s.ticker, s.ts, count(x.ts) AS bars, round(max(x.high), 4) AS top, round(min(x.low), 4) AS bottom
 FROM b s LEFT JOIN b x ON x.ticker = s.ticker AND x.ts > s.ts AND x.ts <= s.ts + INTERVAL '60 days' GROUP BY 1, 2""")
def join_range_after(spark, sf):
    b = V.bars_1d(spark, sf)
    f = J.bars_after(b, ["ticker", "ts"], b, ["high", "low"], 60 * S.DAY)
    arr = F.coalesce(c("future"), F.array().cast("array<struct<ts:timestamp_ntz,high:double,low:double>>"))
    return f.select("ticker", "ts", F.size(arr).cast("long").alias("bars"), r(F.array_max(F.transform(arr, lambda x: x["high"]))).alias("top"),
                    r(F.array_min(F.transform(arr, lambda x: x["low"]))).alias("bottom"))


@query("join_latest_rows", f"""WITH {Q.BARS}, wk AS (SELECT ticker, arg_max(close, ts) AS c1, max(ts) AS t1 FROM b GROUP BY 1),
 f AS (SELECT ticker, arg_min(close, ts) AS c0 FROM b GROUP BY 1) SELECT ticker, t1 AS ts, round(c1, 4) AS close, round(c0, 4) AS first_close,
 round(c1 / nullif(c0, 0) - 1, 4) AS total FROM wk LEFT JOIN f USING (ticker)""")
def join_latest_rows(spark, sf):
    b = V.bars_1d(spark, sf)
    first = b.groupBy("ticker").agg(F.min_by("close", "ts").alias("first_close"))
    return J.latest_rows(b, ["close"]).join(first, "ticker", "left").select(
        "ticker", "ts", r(c("close")).alias("close"), r(c("first_close")).alias("first_close"), r(div(c("close"), c("first_close")) - 1).alias("total"))


@query("join_config_lookup", """SELECT event_id, event_type AS ticker, CAST(CASE event_type WHEN 'click' THEN 1.8 WHEN 'view' THEN 1.6 ELSE 1.5 END AS DOUBLE) AS volume_multiplier FROM events""")
def join_config_lookup(spark, sf):
    cfg = spark.createDataFrame([("click", 1.8), ("view", 1.6)], "ticker string, volume_multiplier double")
    e = V.table(spark, sf, "events").select("event_id", c("event_type").alias("ticker"))
    return J.with_config(e, cfg, "ticker", {"volume_multiplier": 1.5}).select("event_id", "ticker", "volume_multiplier")


@query("join_semi_anti", """SELECT event_id, event_type AS ticker, 'kept' AS side FROM events WHERE event_type IN ('click', 'view', 'error')
 UNION ALL SELECT event_id, event_type, 'other' FROM events WHERE event_type NOT IN ('click', 'view', 'error')""")
def join_semi_anti(spark, sf):
    uni = spark.createDataFrame([("click",), ("view",), ("error",)], "ticker string")
    e = V.table(spark, sf, "events").select("event_id", c("event_type").alias("ticker"))
    return e.join(F.broadcast(uni), "ticker", "left_semi").withColumn("side", F.lit("kept")).unionByName(
        e.join(F.broadcast(uni), "ticker", "left_anti").withColumn("side", F.lit("other"))).select("event_id", "ticker", "side")


# ------------------------------------------------------------------ aggregates

@query("agg_basic", """SELECT event_type AS ticker, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, round(median(value), 4) AS mid,
 round(min(value), 4) AS lo, round(max(value), 4) AS hi, count(DISTINCT user_id) AS users, round(sum(value * greatest(1, user_id)) / sum(greatest(1, user_id)), 4) AS weighted,
 count(*) FILTER (value > 20) AS large, round(quantile_cont(value, 0.33), 4) AS q33, round(quantile_cont(value, 0.67), 4) AS q67 FROM events GROUP BY 1""")
def agg_basic(spark, sf):
    w = F.greatest(F.lit(1), c("user_id"))
    e = V.table(spark, sf, "events").withColumn("ticker", c("event_type"))
    q = exact_quantiles(e, ["ticker"], "value", {"q33": 0.33, "mid": 0.5, "q67": 0.67})
    g = e.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("value")).alias("total"), r(F.avg("value")).alias("mean"),
        r(F.min("value")).alias("lo"), r(F.max("value")).alias("hi"), F.count_distinct("user_id").alias("users"),
        r(F.sum(c("value") * w) / F.sum(w)).alias("weighted"), F.count_if(c("value") > 20).alias("large"))
    return g.join(q.select("ticker", *[r(c(x)).alias(x) for x in ("q33", "mid", "q67")]), "ticker")


@query("agg_pivot_period", """SELECT event_type AS ticker, CAST(count(*) FILTER (ts >= mx - INTERVAL '2 days') AS BIGINT) AS recent,
 CAST(count(*) FILTER (ts < mx - INTERVAL '2 days') AS BIGINT) AS earlier FROM events, (SELECT max(ts) AS mx FROM events) GROUP BY 1""")
def agg_pivot_period(spark, sf):
    e = V.table(spark, sf, "events")
    e = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("mx"))))
    e = e.withColumn("period", F.when(c("ts") >= c("mx") - F.expr("INTERVAL 2 DAYS"), "recent").otherwise("earlier"))
    return e.groupBy(c("event_type").alias("ticker")).pivot("period", ["recent", "earlier"]).count().na.fill(0)


@query("agg_distribution", """SELECT event_type AS pattern, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY event_type), 6) AS share
 FROM events GROUP BY 1, 2""")
def agg_distribution(spark, sf):
    g = V.table(spark, sf, "events").groupBy(c("event_type").alias("pattern"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", r(c("n") / F.sum("n").over(Window.partitionBy("pattern")), 6))


@query("agg_list_set", """SELECT conv_id, count(*) AS messages, string_agg(DISTINCT role, ', ' ORDER BY role) AS participants, min(turn) AS first_turn, max(turn) AS last_turn
 FROM conversations GROUP BY 1""")
def agg_list_set(spark, sf):
    return V.messages(spark, sf).groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("messages"), F.array_join(F.array_sort(F.collect_set("role")), ", ").alias("participants"),
        F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@query("top_k_per_group", f"""WITH {Q.BARS} SELECT ticker, ts, volume FROM b QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY volume DESC, ts) <= 3""")
def top_k_per_group(spark, sf):
    return C.newest_n(V.bars_1d(spark, sf).select("ticker", "ts", "volume"), 3, ["ticker"], [c("volume").desc(), c("ts")])


@query("top_k_global", f"WITH {Q.BARS} SELECT ticker, ts, volume FROM b ORDER BY volume DESC, ts, ticker LIMIT 20")
def top_k_global(spark, sf):
    return V.bars_1d(spark, sf).select("ticker", "ts", "volume").orderBy(c("volume").desc(), "ts", "ticker").limit(20)


@query("set_operations", """SELECT 'both' AS side, count(*) AS n FROM (SELECT l_partkey FROM lineitem INTERSECT SELECT p_partkey FROM part)
 UNION ALL SELECT 'only' AS side, count(*) AS n FROM (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem)""")
def set_operations(spark, sf):
    used = V.table(spark, sf, "lineitem").select(c("l_partkey").alias("p_partkey"))
    parts = V.table(spark, sf, "part").select("p_partkey")
    return used.intersect(parts).agg(F.count(F.lit(1)).alias("n")).select(F.lit("both").alias("side"), "n").unionByName(
        parts.subtract(used).agg(F.count(F.lit(1)).alias("n")).select(F.lit("only").alias("side"), "n"))


@query("union_fill", "SELECT event_id AS id, event_type, CAST(NULL AS BIGINT) AS vec FROM events UNION ALL SELECT vec_id, NULL, label FROM embeddings")
def union_fill(spark, sf):
    a = V.table(spark, sf, "events").select(c("event_id").alias("id"), "event_type")
    b = V.table(spark, sf, "embeddings").select(c("vec_id").alias("id"), c("label").cast("long").alias("vec"))
    return a.unionByName(b, allowMissingColumns=True)


