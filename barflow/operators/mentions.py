"""Ticker mentions and sentiment in text.  All text work is per row in the JVM; only (ticker, hour) rows are shuffled."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barflow.functions.scalar import div, flag, pick
from barflow.operators.clean import clean_text
from barflow.operators.quantiles import exact_quantiles
from barflow.operators.salting import salted_join

c = F.col

# Mention patterns (case as given), trading phrases and labels on upper-cased text, popular names.
CASHTAG = r"\$[A-Z]{1,5}\b"
EXCHANGE_SUFFIX = r"\b[A-Z]{1,5}\.TO\b"
PLAIN = r"\b[A-Z]{2,5}\b"
PHRASES = [
    r"(?:BUY|BUYING|BOUGHT|GRAB|GRABBED|LOADING|LOADED)\s+([A-Z]{2,5})\b",
    r"(?:SELL|SELLING|SOLD|DUMP|DUMPED|DUMPING|SHORT|SHORTING)\s+([A-Z]{2,5})\b",
    r"\b([A-Z]{2,5})\s+(?:CALLS?|PUTS?|OPTIONS?|SHARES?|STOCK|POSITION)",
    r"(?:LONG|BULLISH|BEARISH)\s+(?:ON\s+)?([A-Z]{2,5})\b",
    r"\b([A-Z]{2,5})\s+(?:MOON|MOONING|SQUEEZE|SQUEEZING|EARNINGS|DIVIDEND)",
    r"\bDD\s+(?:ON\s+)?([A-Z]{2,5})\b",
    r"\b([A-Z]{2,5})\s+(?:TO\s+)?(?:THE\s+)?MOON",
    r"\b([A-Z]{2,5})\s+\d+[CP]\b",
    r"(?:TICKER|SYMBOL|STOCK|COMPANY)\s*[:=]\s*([A-Z]{2,5})\b",
    r"\$([A-Z]{1,5})\b",
    r"\(([A-Z]{2,5})\)",
    r"\[([A-Z]{2,5})\]",
]
POPULAR = ["AAPL", "MSFT", "GOOGL", "AMZN", "META", "TSLA", "NVDA", "AMD", "INTC", "SPY", "QQQ", "GME", "AMC", "PLTR"]
# Matched against lower-cased text; the short ones only as words of their own ("drug" is no "rug").
SLANG = [
    (r"🚀|moon|to the moon|tendies|(?:^|[^a-z])ath(?:[^a-z]|$)|rip(p)?ing|squeeze|(?:^|[^a-z])yolo(?:[^a-z]|$)|diamond hands|breakout|gap up|parabolic", 0.6),
    (r"baghold(er)?|dump(ed)?|(?:^|[^a-z])rug(?:[^a-z]|$)|scam|dilution|halt(ed)?|bankrupt|bear trap|selloff|downtrend|gap down|rekt", -0.6),
]
# Our own small lexicon; any word -> weight mapping can be passed instead.
LEXICON = {"good": 0.5, "great": 0.75, "best": 0.75, "gain": 0.5, "gains": 0.5, "profit": 0.6, "win": 0.6, "strong": 0.5, "up": 0.25, "beat": 0.5,
           "bad": -0.5, "worst": -0.75, "loss": -0.5, "losses": -0.5, "weak": -0.5, "down": -0.25, "miss": -0.5, "fear": -0.5, "risk": -0.3, "crash": -0.75}


def fold(text: Column) -> Column:
    """Accented letters become '_': they join words but are never part of a symbol."""
    return F.regexp_replace(text, "[À-ÖØ-öø-ÿ]", "_")


def extract(posts: DataFrame, universe: DataFrame) -> DataFrame:
    """One row per post and distinct ticker: cashtags, .TO symbols, and upper-case tokens found in ``universe``."""
    t = fold(c("text"))

    def all_of(p):
        return F.regexp_extract_all(t, F.lit(f"({p})"), F.lit(1))
    sure = F.array_distinct(F.transform(F.array_union(all_of(CASHTAG), all_of(EXCHANGE_SUFFIX)), lambda x: F.regexp_replace(x, r"\$", "")))
    df = posts.withColumns({"_sure": sure, "_plain": F.array_except(F.array_distinct(all_of(PLAIN)), sure)}).drop("text")
    names = F.concat(F.transform("_sure", lambda x: F.struct(x.alias("ticker"), F.lit(True).alias("sure"))),
                     F.transform("_plain", lambda x: F.struct(x.alias("ticker"), F.lit(False).alias("sure"))))
    df = df.withColumn("_m", F.explode(names)).withColumns({"ticker": c("_m.ticker"), "_ok": c("_m.sure")}).drop("_m", "_sure", "_plain")
    known = universe.select("ticker").distinct().withColumn("_known", F.lit(True))
    return df.join(known, "ticker", "left").filter(c("_ok") | c("_known")).drop("_ok", "_known")


def extract_strict(posts: DataFrame, universe: DataFrame) -> DataFrame:
    """Only symbols in a clear trading context, kept when in ``universe`` (semi join)."""
    df = posts.withColumn("_u", F.upper(fold(c("text"))))
    found = F.array().cast("array<string>")
    for p in PHRASES:
        found = F.array_union(found, F.regexp_extract_all("_u", F.lit(p), F.lit(1)))
    near = F.array(*[F.when(c("_u").rlike(rf"\b{s}\b.{{0,20}}(\$\d+|\d+%)|(\$\d+|\d+%).{{0,20}}\b{s}\b"), F.lit(s)) for s in POPULAR])
    df = df.withColumn("ticker", F.explode(F.array_distinct(F.array_union(found, F.filter(near, lambda x: x.isNotNull()))))).drop("_u")
    return df.join(universe.select("ticker"), "ticker", "left_semi")


def sentiment(text: Column, lexicon: dict[str, float] | None = None) -> Column:
    """Mean weight of the known words, 0 without any, plus 0.6 for bullish and minus 0.6 for bearish slang."""
    lex = lexicon or LEXICON
    table = F.create_map(*[x for k, v in lex.items() for x in (F.lit(k), F.lit(float(v)))])
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit(f"(?<![a-z])({'|'.join(sorted(lex, key=len, reverse=True))})(?![a-z])"), F.lit(1))
    hits = F.transform(words, lambda w: F.try_element_at(table, w))   # only the known words, so the map sees few lookups
    base = F.coalesce(div(F.aggregate(hits, F.lit(0.0), lambda a, x: a + x), F.size(hits)), F.lit(0.0))
    for pattern, weight in SLANG:
        base = base + F.when(low.rlike(pattern), weight).otherwise(0.0)
    return base


def prepare(posts: DataFrame, lexicon: dict[str, float] | None = None, high_score: float = 500.0) -> DataFrame:
    df = posts.withColumn("text", clean_text(c("text")))
    zero = F.lit(0.0)
    return df.withColumns({
        "engagement": F.greatest(F.coalesce("score", zero) + F.coalesce("num_comments", zero), zero),
        "influencer": flag(c("score") >= high_score), "sent": sentiment(c("text"), lexicon)})


def hourly_features(mentions: DataFrame) -> DataFrame:
    """Mentions, mean and exact median sentiment, engagement and influencers per (ticker, hour)."""
    df = mentions.withColumn("hour_utc", F.date_trunc("hour", "created_utc").cast(mentions.schema["created_utc"].dataType))
    key = ["ticker", "hour_utc"]
    g = df.groupBy(*key).agg(F.count(F.lit(1)).alias("mentions"), F.avg("sent").alias("sent_avg"), F.sum("engagement").alias("engagement_sum"),
                             F.sum("influencer").alias("influencers"))
    return g.join(exact_quantiles(df, key, "sent", {"sent_med": 0.5}), key)


def robust_z_last(features: DataFrame, x: str, out: str, least: int = 10) -> DataFrame:
    """Per ticker the newest value as (x - median) / (1.4826 MAD), sd where MAD is 0, 0 for fewer than ``least`` rows."""
    med = exact_quantiles(features, ["ticker"], x, {"_med": 0.5})
    df = salted_join(features, med, ["ticker"], ["hour_utc"]).withColumn("_dev", F.abs(c(x) - c("_med")))
    mad = exact_quantiles(df, ["ticker"], "_dev", {"_mad": 0.5})
    g = df.groupBy("ticker").agg(F.max_by(c(x), c("hour_utc")).alias("_last"), F.first("_med").alias("_med"), F.stddev_samp(x).alias("_sd"), F.count(x).alias("_n"))
    s = F.when(c("_mad") > 0, 1.4826 * c("_mad")).otherwise(c("_sd"))
    z = F.coalesce(div(c("_last") - c("_med"), s), F.lit(0.0))
    return g.join(mad, "ticker").select("ticker", F.when(c("_n") < least, 0.0).otherwise(z).alias(out))


def hype(features: DataFrame, lookback: int = 24, baseline_days: int = 7) -> DataFrame:
    """Growth of the last day against the week before, sentiment level and momentum, hype index and alert flag.

    The reference time is the newest hour in the table."""
    now = features.agg(F.max("hour_utc").alias("_end"))
    df = features.crossJoin(F.broadcast(now))
    hrs = (F.unix_seconds(c("_end").cast("timestamp")) - F.unix_seconds(c("hour_utc").cast("timestamp"))) / 3600
    df = df.withColumn("_age", hrs).filter(c("_age") <= lookback - 1 + 24 * baseline_days)
    cur, base = c("_age") <= lookback - 1, c("_age") > lookback - 1
    last6, prev6 = c("_age") <= 5, (c("_age") <= 11) & (c("_age") > 5)
    w = F.greatest(F.lit(1), c("mentions"))
    g = df.groupBy("ticker").agg(
        F.sum(F.when(cur, c("mentions"))).alias("mentions_24h"),
        div(F.sum(F.when(cur, c("sent_avg") * w)), F.sum(F.when(cur, w))).alias("sent_24h"),
        F.sum(F.when(cur, c("engagement_sum"))).alias("engagement_24h"), F.sum(F.when(cur, c("influencers"))).alias("influencers_24h"),
        F.coalesce(F.avg(F.when(base, c("mentions"))) * 24, F.lit(0.0)).alias("mentions_base"),
        F.coalesce(F.avg(F.when(base, c("engagement_sum"))) * 24, F.lit(0.0)).alias("engagement_base"),
        F.count_if(last6).alias("_n6"), F.count_if(prev6).alias("_p6"), F.avg(F.when(last6, c("sent_avg"))).alias("_s6"),
        F.avg(F.when(prev6, c("sent_avg"))).alias("_q6"), F.count_if(cur).alias("hours_covered")).filter(c("mentions_24h").isNotNull())
    g = g.withColumns({
        "sent_momo": F.when((c("_n6") >= 2) & (c("_p6") >= 2), F.coalesce(c("_s6") - c("_q6"), F.lit(0.0))).otherwise(0.0),
        "mentions_growth": 100 * (c("mentions_24h") - c("mentions_base")) / F.greatest(c("mentions_base"), F.lit(5.0)),
        "engagement_growth": 100 * (c("engagement_24h") - c("engagement_base")) / F.greatest(c("engagement_base"), F.lit(50.0))})
    recent = df.drop("_end", "_age")
    g = g.join(robust_z_last(recent, "engagement_sum", "engagement_z"), "ticker", "left").join(
        robust_z_last(recent, "mentions", "mentions_z"), "ticker", "left")
    span = g.agg(F.min("mentions_growth").alias("_lo"), F.max("mentions_growth").alias("_hi"))
    g = g.crossJoin(F.broadcast(span))
    scaled = F.coalesce(3 * div(c("mentions_growth") - c("_lo"), c("_hi") - c("_lo")), F.lit(1.5))
    g = g.withColumn("hype_index", 0.35 * scaled + 0.0 * c("engagement_z") + 0.2 * c("sent_24h") + 0.2 * c("sent_momo"))
    return g.withColumn("alert", flag((c("mentions_24h") >= 10) & (c("mentions_growth") >= 100) & (c("hype_index") >= 1.2))).drop(
        "_n6", "_p6", "_s6", "_q6", "_lo", "_hi")


def mention_summary(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("ticker").agg(F.count(F.lit(1)).alias("mentions"), F.count_if(c("type") == "post").alias("posts"),
                                          F.count_if(c("type") == "comment").alias("comments"), F.count_distinct("subreddit").alias("subreddits"),
                                          F.avg("score").alias("avg_score"))


def trends(history: DataFrame, recent_days: int = 2) -> DataFrame:
    """Daily aggregates, recency, momentum and a category per ticker against the newest date of the history."""
    daily = history.groupBy("ticker", F.to_date("ts").alias("date")).agg(F.sum("mentions").alias("daily"), F.max("mentions").alias("peak"))
    today = daily.agg(F.max("date").alias("_today"))
    daily = daily.crossJoin(F.broadcast(today))
    recent = c("date") >= F.date_sub("_today", recent_days)
    g = daily.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("days_active"), F.sum("daily").alias("total"), F.avg("daily").alias("avg_daily"), F.max("daily").alias("max_daily"),
        F.max(F.datediff("_today", "date")).alias("days_since_first"), F.min(F.datediff("_today", "date")).alias("_ago"),
        F.coalesce(F.sum(F.when(recent, c("daily"))), F.lit(0)).alias("recent"), F.coalesce(F.sum(F.when(~recent, c("daily"))), F.lit(0)).alias("earlier"))
    g = g.withColumns({"momentum": F.when(c("earlier") > 0, c("recent") / c("earlier")).otherwise(c("recent").cast("double")),
                       "growth_pct": F.when(c("earlier") > 0, 100.0 * (c("recent") - c("earlier")) / c("earlier")).otherwise(100.0),
                       "recency": 1 / (c("_ago") + 1)})
    m = c("momentum")
    return g.withColumns({
        "trend_score": c("total") * 0.3 + m * 10 + c("recency") * 20 + c("days_active") * 2,
        "category": pick(((c("days_since_first") <= 1) & (c("total") >= 5), "NEW ENTRY"), ((m > 3) & (c("total") >= 10), "EXPLOSIVE"),
                         ((m > 1.5) & (c("days_active") >= 3), "TRENDING UP"), ((c("days_active") >= 5) & (c("avg_daily") >= 10), "SUSTAINED HEAT"),
                         ((m < 0.5) & (c("days_since_first") > 3), "COOLING OFF"), default="WATCHING")}).drop("_ago")


# Entities decoded after the tags are gone.
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]


def strip_html(x: Column) -> Column:
    x = F.regexp_replace(x, "<[^>]+>", "")
    for entity, plain in ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(plain))
    return F.trim(x)


def message_fields(text: Column) -> dict[str, Column]:
    """First mail address, order number and amount, NULL where absent."""
    def first(p):
        return F.nullif(F.regexp_extract(text, p, 0), F.lit(""))
    return {"address": first(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"), "order_number": first(r"Order #[0-9]+|Order Number: [0-9]+"),
            "amount": first(r"\$[0-9,]+\.?[0-9]*"), "preview": F.substring(text, 1, 200)}
