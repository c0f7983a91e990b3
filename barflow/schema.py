"""Declared schemas of the tables the operators read and write."""
from pyspark.sql import types as T

BAR = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
])

TICK = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("size", T.DoubleType()),
])

POST = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("subreddit", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("num_comments", T.DoubleType()),
    T.StructField("text", T.StringType()),
    T.StructField("created_utc", T.TimestampType()),
])

PREDICTION = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("date", T.DateType()),
    T.StructField("hour", T.IntegerType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("pred_pct", T.DoubleType()),
    T.StructField("direction", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
])
