"""Cleaning, reshaping and time predicates."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barflow.functions.scalar import pick
from barflow.operators.salting import salted_join

c = F.col

# Column names seen in bar files -> ours.
BAR_NAMES = {
    "ticker": ["ticker", "symbol"], "ts": ["ts", "timestamp", "datetime", "date"], "open": ["open"], "high": ["high"],
    "low": ["low"], "close": ["close", "adj close", "adj_close", "adjclose"], "volume": ["volume", "vol"],
}


def normalise_bars(df: DataFrame) -> DataFrame:
    """Rename by any known name (case ignored), coerce prices and volume to numbers, drop rows with a hole."""
    have = {n.lower().strip(): n for n in df.columns}
    cols = []
    for ours, names in BAR_NAMES.items():
        found = [c(f"`{have[n]}`") for n in names if n in have]
        if not found:
            raise ValueError(f"no column for {ours} among {df.columns}")
        col = found[0] if len(found) == 1 else F.coalesce(*found)
        cols.append((col if ours in ("ticker", "ts") else col.try_cast("double")).alias(ours))
    return df.select(*cols).na.drop()


def wide_to_long(df: DataFrame, metrics: list[str], sep: str = "|") -> DataFrame:
    """Columns named metric|ticker -> one row per (ticker, ts); rows without a close are dropped."""
    wide = [n for n in df.columns if sep in n]
    long = df.unpivot(["ts"], [f"`{n}`" for n in wide], "_name", "_value")
    parts = F.split("_name", "[" + sep + "]")
    long = long.withColumns({"metric": F.lower(parts[0]), "ticker": parts[1]})
    out = long.groupBy("ticker", "ts").agg(*[
        F.max(F.when(c("metric") == m, c("_value"))).alias(m) for m in metrics])
    return out.filter(c("close").isNotNull())


def to_exchange_time(ts: Column) -> Column:
    """A zone-less UTC time as New York wall-clock time."""
    return F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), ts.cast("timestamp_ntz"))


def in_regular_session(ts: Column) -> Column:
    """09:30 <= clock <= 16:00 on a weekday."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    return (minute >= 570) & (minute <= 960) & F.dayofweek(ts).between(2, 6)


def last_trading_day(ts: Column) -> Column:
    """Before the open the previous day counts; weekends roll back to Friday."""
    day = F.when(F.hour(ts) * 60 + F.minute(ts) < 570, F.date_sub(ts.cast("date"), 1)).otherwise(ts.cast("date"))
    dow = F.dayofweek(day)
    return F.date_sub(day, F.when(dow == 1, 2).when(dow == 7, 1).otherwise(0))


def market_status(ts: Column) -> Column:
    minute = F.hour(ts) * 60 + F.minute(ts)
    return pick((F.dayofweek(ts).isin(1, 7), "Weekend"), (minute < 570, "Pre-Market"), (minute <= 960, "Open"),
                default="After-Hours")


def recent(df: DataFrame, days: int) -> DataFrame:
    """Rows within ``days`` of the newest row of the table (one-row broadcast)."""
    newest = df.agg(F.max("ts").alias("_newest"))
    return df.crossJoin(F.broadcast(newest)).filter(
        c("ts") >= c("_newest") - F.make_dt_interval(days=F.lit(days))).drop("_newest")


def latest_session(df: DataFrame) -> DataFrame:
    """Rows of the latest date of each ticker."""
    last = df.groupBy("ticker").agg(F.max(F.to_date("ts")).alias("_d"))
    return salted_join(df, last, ["ticker"], ["ts"]).filter(F.to_date("ts") == c("_d")).drop("_d")


def unify(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union over the columns both have."""
    common = [n for n in a.columns if n in b.columns]
    return a.select(*common).unionByName(b.select(*common))


def distinct_posts(posts: DataFrame) -> DataFrame:
    return posts.dropDuplicates(["url", "type", "text", "created_utc"])


# Accepted time formats, tried in this order.
TIME_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "M/d/yyyy HH:mm:ss", "M/d/yyyy HH:mm", "yyyy-MM-dd"]


def parse_time(x: Column) -> Column:
    """ISO with or without T and Z, month/day/year, plain date, or epoch seconds; NULL otherwise."""
    raw = F.trim(x)
    iso = F.regexp_replace(F.regexp_replace(raw, "(?i)z$", ""), "T", " ")
    tries = [F.try_to_timestamp(raw if "/" in f else iso, F.lit(f)) for f in TIME_FORMATS]
    epoch = F.when(raw.rlike(r"^[0-9]+(\.[0-9]+)?$"), F.timestamp_seconds(raw.try_cast("double")))
    return F.coalesce(*tries, epoch)


def clean_text(x: Column) -> Column:
    """Line breaks and control characters to blanks, runs of blanks to one, trimmed; NULL to empty."""
    x = F.regexp_replace(F.coalesce(x, F.lit("")), r"[\x00-\x1F\x7F]+", " ")
    return F.trim(F.regexp_replace(x, " +", " "))


def quality_report(bars: DataFrame, complete: tuple[int, ...] = (24, 25, 20)) -> DataFrame:
    """Bars per day, complete days, ranges and a label for each ticker; two-level aggregation."""
    day = bars.groupBy("ticker", F.to_date("ts").alias("date")).agg(
        F.count(F.lit(1)).alias("n"), F.min("low").alias("lo"), F.max("high").alias("hi"), F.sum("volume").alias("vol"),
        F.min("volume").alias("vmin"), F.max("volume").alias("vmax"))
    a, b, d = complete
    rep = day.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("days"), F.sum("n").alias("bars"), F.avg("n").alias("bars_per_day"), F.min("n").alias("min_per_day"),
        F.max("n").alias("max_per_day"), F.count_if(c("n") >= a).alias(f"days_{a}"), F.count_if(c("n") >= b).alias(f"days_{b}"),
        F.count_if(c("n") >= d).alias(f"days_{d}"), F.min("lo").alias("low"), F.max("hi").alias("high"),
        F.min("vmin").alias("min_volume"), F.max("vmax").alias("max_volume"), F.sum("vol").alias("volume"))
    per_day = c("bars_per_day")
    return rep.withColumn("quality", pick((per_day >= a, "EXCELLENT"), (per_day >= d, "GOOD"), default="SPARSE"))


def yearly_counts(bars: DataFrame) -> DataFrame:
    """Bars per (ticker, year) with the sub-totals of a roll-up; -1 / '*' stand for all."""
    g = bars.rollup("ticker", F.year("ts").alias("year")).agg(F.count(F.lit(1)).alias("bars"),
                                                             F.grouping_id().alias("_g"))
    return g.select(F.when(c("_g") == 3, F.lit("*")).otherwise(c("ticker")).alias("ticker"),
                    F.when(c("_g") >= 1, F.lit(-1)).otherwise(c("year")).alias("year"), "bars")


def enough_history(df: DataFrame, least: int) -> DataFrame:
    """Tickers with at least ``least`` rows; counts combine map-side and the semi join prunes the rest."""
    ok = df.groupBy("ticker").agg(F.count(F.lit(1)).alias("_n")).filter(c("_n") >= least).select("ticker")
    return salted_join(df, ok, ["ticker"], ["ts"], "left_semi")


def newest_n(df: DataFrame, n: int, by: list[str] | None = None, order: list[Column] | None = None) -> DataFrame:
    """The last n rows of a log (per key); the row_number filter is pushed into the sort as a group limit."""
    order = order or [c("ts").desc()]
    if not by:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(c("_rn") <= n).drop("_rn")
