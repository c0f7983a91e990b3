"""Bars from trades, venue consolidation, resampling."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from barflow.functions.scalar import div


def tumbling_bars(ticks: DataFrame, width: str, tie: str | None = None) -> DataFrame:
    """Trades -> OHLCV bars of a fixed width; empty bars do not appear.  All aggregates combine map-side."""
    order = F.struct("ts", tie) if tie else F.col("ts")
    win = F.window("ts", width)
    return (
        ticks.groupBy("ticker", win.alias("_win"))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
             F.max_by("price", order).alias("close"), F.sum("size").alias("volume"),
             F.count(F.lit(1)).alias("trades"))
        .select("ticker", F.col("_win.start").alias("ts"), "open", "high", "low", "close", "volume", "trades")
    )


def day_bars(ticks: DataFrame, order_cols: list[str]) -> DataFrame:
    """Trades that already carry a bar time -> one bar per (ticker, ts)."""
    order = F.struct(*order_cols)
    return ticks.groupBy("ticker", "ts").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("size").alias("volume"))


def consolidate_venues(bars: DataFrame) -> DataFrame:
    """Several venues per (ticker, ts) -> one bar; open/close by venue order, VWAP over the venues' closes."""
    return bars.groupBy("ticker", "ts").agg(
        F.min_by("open", "venue").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "venue").alias("close"), F.sum("volume").alias("volume"),
        div(F.sum(F.col("close") * F.col("volume")), F.sum("volume")).alias("vwap"),
        F.count(F.lit(1)).alias("venues"))


def rollup_bars(bars: DataFrame, unit: str) -> DataFrame:
    """Bars -> coarser bars ('hour', 'day', 'week', 'month')."""
    return (
        bars.withColumn("_t", F.date_trunc(unit, "ts").cast(bars.schema["ts"].dataType))
        .groupBy("ticker", "_t")
        .agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
             F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
        .withColumnRenamed("_t", "ts")
    )


def upsample(bars: DataFrame, parts: int = 4, step: str = "INTERVAL 15 MINUTES") -> DataFrame:
    """Each hour bar -> ``parts`` bars with an equal share of the volume; the clock gap to the next bar is filled
    with the last known prices and no volume.

    A bar owns the grid from its own time up to the next bar, so filling needs the next bar's time only
    and each row expands by itself."""
    from barflow.operators import series as S
    df = S.blocked(bars, interval_s=3600)
    df = S.unblock(df.withColumn("_next", S.lead("ts")))
    last = F.coalesce(F.col("_next") - F.expr(step), F.col("ts") + F.expr(f"{parts - 1} * {step}"))
    grid = F.posexplode(F.sequence(F.col("ts"), last, F.expr(step)))
    own = F.col("_i") < parts
    return df.select("ticker", "open", "high", "low", "close", "volume", grid.alias("_i", "ts")).select(
        "ticker", "ts", "open", "high", "low", "close",
        F.when(own, F.col("volume") / parts).otherwise(F.lit(0.0)).alias("volume"),
        F.when(own, F.lit(0)).otherwise(F.lit(1)).alias("filled"))


def session_number(bars: DataFrame) -> DataFrame:
    """Session date and 1-based bar number in the session (a session is bounded by the clock)."""
    ws = Window.partitionBy("ticker", "date").orderBy("ts")
    return bars.withColumn("date", F.to_date("ts")).withColumn("bar_no", F.row_number().over(ws))
