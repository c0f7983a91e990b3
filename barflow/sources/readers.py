"""Readers: Parquet and CSV bars, JSON envelopes, partitioned logs, dated pattern files, symbol lists."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from barflow import schema
from barflow.operators.clean import normalise_bars, parse_time

c = F.col


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.BAR).parquet(path)


def read_bar_csv(spark: SparkSession, path: str, ticker: str) -> DataFrame:
    """CSV bars of one ticker whose time column has any of the known names."""
    raw = spark.read.option("header", True).csv(path)
    low = {n.lower(): n for n in raw.columns}
    if "ticker" not in low and "symbol" not in low:
        raw = raw.withColumn("ticker", F.lit(ticker))
    df = normalise_bars(raw)
    return df.withColumn("ts", parse_time(c("ts")).cast("timestamp_ntz")).filter(c("ts").isNotNull())


ENVELOPE = T.StructType([T.StructField("data", T.ArrayType(T.StructType([
    T.StructField("timestamp", T.StringType()), T.StructField("Open", T.DoubleType()), T.StructField("High", T.DoubleType()),
    T.StructField("Low", T.DoubleType()), T.StructField("Close", T.DoubleType()), T.StructField("Volume", T.DoubleType())])))])


def read_envelope(spark: SparkSession, path: str, ticker: str | None = None, least: int = 100) -> DataFrame:
    """{"data": [...]} files -> bars of ``ticker``, or of the ticker that the files' folder names (``ticker=...``). Short files, and bars that lack a required
    field, fail when the rows are read, not by a count up front."""
    raw = spark.read.schema(ENVELOPE).option("multiLine", True).json(path)
    name = c("ticker").cast("string") if ticker is None else F.lit(ticker)
    ok = F.when(F.size("data") >= least, c("data")).otherwise(
        F.raise_error(F.concat(name, F.lit(f": fewer than {least} rows, got "), F.size("data").cast("string"))))

    def lacking(field: str):
        return F.size(F.filter("data", lambda b: b[field].isNull()))

    for field in ("timestamp", "Open", "High", "Low", "Close", "Volume"):
        ok = F.when(lacking(field) > 0, F.raise_error(F.concat(name, F.lit(": "), lacking(field).cast("string"), F.lit(f" bars lack the required field {field}")))).otherwise(ok)
    df = raw.select(name.alias("ticker"), F.explode(ok).alias("b"))
    return df.select("ticker", parse_time(c("b.timestamp")).cast("timestamp_ntz").alias("ts"),
                     c("b.Open").alias("open"), c("b.High").alias("high"), c("b.Low").alias("low"), c("b.Close").alias("close"),
                     c("b.Volume").alias("volume"))


def read_log(spark: SparkSession, path: str, until, days: int, struct=schema.PREDICTION) -> DataFrame:
    """Rows of the last ``days`` dates of a log partitioned by ticker/date/hour; the filter prunes partitions."""
    df = spark.read.schema(struct).json(path)
    return df.filter((c("date") > F.date_sub(F.lit(until).cast("date"), days)) & (c("date") <= F.lit(until).cast("date")))


def read_dated_csv(spark: SparkSession, folder: str, day: str) -> DataFrame:
    """Pattern files whose path carries the date; the filter on the path prunes files before they are opened."""
    df = spark.read.option("header", True).option("recursiveFileLookup", True).csv(folder)
    return df.select("*", c("_metadata.file_path").alias("file")).filter(c("file").contains(day))


def read_symbols(spark: SparkSession, path: str, stop_words: DataFrame) -> DataFrame:
    """Pipe-delimited symbols without the trailer line and without common words. Whether those are broadcast is left to the session's size check."""
    df = spark.read.option("header", True).option("sep", "|").csv(path).select(F.trim("Symbol").alias("ticker"))
    df = df.filter(c("ticker").isNotNull() & ~c("ticker").contains("File Creation"))
    return df.join(stop_words, df["ticker"] == stop_words["word"], "left_anti")
