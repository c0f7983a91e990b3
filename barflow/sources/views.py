"""The driver's tables seen as market data: trades, bars, venues, posts, messages."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barflow.operators import bars as B, series as S


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def line_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as trades: supplier is the ticker, unit price the price, quantity the size."""
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("ticker"), F.col("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("size"),
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("venue"))


def bars_1d(spark: SparkSession, sf: str) -> DataFrame:
    ticks = line_ticks(spark, sf)
    return S.spanned(B.day_bars(ticks, ["l_orderkey", "l_linenumber", "l_partkey"]), ticks)


def venue_bars(spark: SparkSession, sf: str) -> DataFrame:
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey")
    return line_ticks(spark, sf).groupBy("ticker", "ts", "venue").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("size").alias("volume"))


def event_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Events as trades: event type is the ticker, value the price, k in props the size."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("ticker"), "ts", F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("size"), "event_id")


def bars_15m(spark: SparkSession, sf: str) -> DataFrame:
    ticks = event_ticks(spark, sf)
    return S.spanned(B.tumbling_bars(ticks, "15 minutes", "event_id").drop("trades"), ticks)


def bars_1h(spark: SparkSession, sf: str) -> DataFrame:
    ticks = event_ticks(spark, sf)
    return S.spanned(B.tumbling_bars(ticks, "1 hour", "event_id").drop("trades"), ticks)


def bars_1w(spark: SparkSession, sf: str) -> DataFrame:
    return S.spanned(B.rollup_bars(bars_1d(spark, sf), "week"), line_ticks(spark, sf))


# Documents carry no time, author or votes: these rules stand in for them.
POST_EPOCH = "2024-01-01 00:00:00"


def posts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(
        F.when(F.col("doc_id") % 3 == 0, F.lit("post")).otherwise(F.lit("comment")).alias("type"),
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("source").alias("subreddit"), F.col("lang").alias("author"),
        (F.col("n_chars") % 1000).cast("double").alias("score"),
        (F.col("n_chars") % 37).cast("double").alias("num_comments"), "text",
        (F.lit(POST_EPOCH).cast("timestamp_ntz")
         + F.make_dt_interval(mins=(F.col("doc_id") * 10).cast("int"))).alias("created_utc"))


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages")
