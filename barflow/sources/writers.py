"""Writers: overwrite with a dated copy, day upsert, keyed merge, capped log, feature store, retention, exports."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from barflow.session import cut_lineage

c = F.col


def write_latest_and_copy(df: DataFrame, folder: str, stamp: str) -> None:
    """The current file and a copy under its stamp; the copy is made from the written file, not recomputed."""
    df.write.mode("overwrite").parquet(f"{folder}/latest")
    df.sparkSession.read.parquet(f"{folder}/latest").write.mode("overwrite").parquet(f"{folder}/history/{stamp}")


def upsert_days(df: DataFrame, folder: str) -> None:
    """Replace the dates present in ``df``, keep all others; running it again changes nothing."""
    (df.withColumn("date", F.to_date("ts")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(folder))


def merge_days(df: DataFrame, folder: str, key: list[str]) -> None:
    """Add ``df`` to the dates in ``folder``: stored rows of a date stay unless ``df`` has their key (``df`` has a key once per date)."""
    new = df.withColumn("date", F.to_date("ts"))
    try:
        old = df.sparkSession.read.schema(new.schema).parquet(folder).join(new.select("date").distinct(), "date", "left_semi")
        new = merge_latest(old.select(*new.columns), new, [*{*key, "date"}])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    upsert_days(cut_lineage(new.select(*df.columns)), folder)       # read to the end before its dates are overwritten


def replace_days(history: DataFrame, new: DataFrame) -> DataFrame:
    """The same as a frame: history without the dates of ``new``, plus ``new``."""
    days = new.select(F.to_date("ts").alias("_d")).distinct()
    kept = history.withColumn("_d", F.to_date("ts")).join(days, "_d", "left_anti").drop("_d")
    return kept.unionByName(new)


def merge_latest(history: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Union where the newer source wins per key; max_by combines map-side, so a hot key is one row per task."""
    both = history.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)))
    cols = [x for x in history.columns if x not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*cols), "_src").alias("_x")).select(*key, "_x.*")


def append_capped(log: DataFrame, new: DataFrame, cap: int, order: list[Column]) -> DataFrame:
    """Log plus new rows, the newest ``cap`` kept (top-k, no full sort)."""
    return log.unionByName(new, allowMissingColumns=True).orderBy(*order).limit(cap)


def insert_absent(store: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Feature store: rows whose key is not there yet are added, present ones stay."""
    return store.unionByName(new.join(store.select(*key), key, "left_anti").select(*store.columns))


def append_snapshot(df: DataFrame, folder: str, stamp: str) -> None:
    """Add ``df`` to a history of snapshots under its stamp; writing a stamp again replaces that snapshot alone."""
    (df.withColumn("snapshot", F.lit(stamp)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("snapshot").parquet(folder))


def retain_hours(df: DataFrame, hours: int = 168) -> DataFrame:
    """Rows younger than ``hours`` against the newest row (one-row broadcast)."""
    newest = df.agg(F.max("ts").alias("_newest"))
    return df.crossJoin(F.broadcast(newest)).filter(
        c("ts") > c("_newest") - F.make_dt_interval(hours=F.lit(hours))).drop("_newest")


def write_predictions(df: DataFrame, folder: str) -> None:
    """JSON by ticker/date/hour.  Rows meet their directory in one task (few files); a hot ticker spreads over its hours."""
    key = ["ticker", "date", "hour"]
    (df.withColumns({"date": F.to_date("ts"), "hour": F.hour("ts")}).repartition(*key).write.mode("append")
     .partitionBy(*key).json(folder))


def write_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(folder)
