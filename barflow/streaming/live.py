"""Live bars, alerts and predictions with Structured Streaming.

Times are TIMESTAMP (watermarks reject zone-less ones).  Closed windows equal the batch operators."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barflow.functions.scalar import div

c = F.col
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_ticks(spark: SparkSession, path: str) -> DataFrame:
    """Event files as a stream of trades."""
    schema = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
    df = spark.readStream.schema(schema).parquet(path)
    return df.select(c("event_type").alias("ticker"), c("ts").cast("timestamp").alias("ts"), c("value").alias("price"),
                     F.get_json_object("props", "$.k").cast("double").alias("size"), "event_id")


def windowed_bars(ticks: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling (or sliding) OHLCV bars with VWAP; rows later than the watermark are dropped."""
    win = F.window("ts", width, slide) if slide else F.window("ts", width)
    order = F.struct("ts", "event_id")
    return ticks.withWatermark("ts", late).groupBy("ticker", win.alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("size").alias("volume"), F.count(F.lit(1)).alias("trades"), div(F.sum(c("price") * c("size")), F.sum("size")).alias("vwap")) \
        .select("ticker", c("w.start").alias("ts"), c("w.end").alias("end_ts"), "open", "high", "low", "close", "volume", "trades", "vwap")


def activity_sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Bursts of activity per ticker, closed by a gap."""
    return ticks.withWatermark("ts", late).groupBy("ticker", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")) \
        .select("ticker", c("w.start").alias("start_ts"), c("w.end").alias("end_ts"), "n")


def first_alert(alerts: DataFrame, keys: list[str], window: str = "4 hours") -> DataFrame:
    """One alert per key within the watermark window."""
    return alerts.withWatermark("ts", window).dropDuplicatesWithinWatermark(keys)


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def gathered(rows: Iterator[pd.DataFrame], cols: list[str]) -> dict[str, np.ndarray]:
    """Columns of a key's rows of one batch, by time; frames are read one after another and only these columns are kept. Times as nanoseconds."""
    parts: dict[str, list[np.ndarray]] = {x: [] for x in cols}
    for frame in rows:
        for x in cols:
            v = frame[x]
            parts[x].append(v.to_numpy("datetime64[ns]").astype(np.int64) if x == "ts" else v.to_numpy(float))
    out = {x: np.concatenate(v) for x, v in parts.items()}
    order = np.argsort(out["ts"], kind="stable")
    return {x: v[order] for x, v in out.items()}


def _ns(ts) -> int:
    return pd.Timestamp(ts).value


class LastSent(StatefulProcessor):
    """Lets an alert pass when its key was not sent in the last ``hours``; a later pass restarts the clock. The next time that passes is found by
    bisection, so a batch costs as many steps as it sends alerts. A timer drops the state once the watermark is past the gap: whatever comes
    then passes anyway."""

    def __init__(self, hours: float = 4.0):
        self.gap = pd.Timedelta(hours=hours).value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sent = handle.getValueState("sent", "ts TIMESTAMP")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ts = gathered(rows, ["ts"])["ts"]
        last = _ns(self.sent.get()[0]) if self.sent.exists() else None
        out, i = [], 0 if last is None else int(np.searchsorted(ts, last + self.gap))
        while i < len(ts):
            out.append(ts[i])
            i = int(np.searchsorted(ts, ts[i] + self.gap))
        if out:
            self.sent.update((pd.Timestamp(out[-1]).to_pydatetime(),))
            self.handle.registerTimer((int(out[-1]) + self.gap) // 1_000_000)
        yield pd.DataFrame({"alert_id": [key[0]] * len(out), "ts": pd.to_datetime(out)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1_000_000
        if self.sent.exists() and _ns(self.sent.get()[0]) + self.gap <= now:        # not when an alert was sent since
            self.sent.clear()
        return iter(())

    def close(self) -> None:
        pass


def suppress_repeats(alerts: DataFrame, hours: float = 4.0, late: str = "10 minutes") -> DataFrame:
    """Exact last-sent rule on (alert_id, ts); state of a key ends ``hours`` after its last alert."""
    return alerts.withWatermark("ts", late).groupBy("alert_id").transformWithStateInPandas(
        LastSent(hours), "alert_id STRING, ts TIMESTAMP", "Append", "EventTime")


def carried_mean(x: np.ndarray, y0: float, alpha: float, chunk: int = 256) -> np.ndarray:
    """y = y' + alpha * (x - y'), starting after ``y0``, a chunk of rows at a time."""
    q, out = 1.0 - alpha, np.empty(len(x))
    for a in range(0, len(x), chunk):
        part = x[a:a + chunk]
        k = np.arange(1, len(part) + 1)
        ages = k[:, None] - k[None, :]
        weights = np.where(ages >= 0, alpha * q ** np.maximum(ages, 0), 0.0)
        out[a:a + chunk] = weights @ part + y0 * q ** k
        y0 = out[a + len(part) - 1]
    return out


class RunningIndicators(StatefulProcessor):
    """EMA, Wilder RSI and VWAP carried per ticker; six numbers of state."""

    def __init__(self, span: int, period: int):
        self.a, self.b = 2.0 / (span + 1), 1.0 / period

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("s", "close DOUBLE, ema DOUBLE, up DOUBLE, dn DOUBLE, pv DOUBLE, v DOUBLE")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        x = gathered(rows, ["ts", "close", "volume"])
        close, volume = x["close"], x["volume"]
        s = list(self.state.get()) if self.state.exists() else [close[0], close[0], 0.0, 0.0, 0.0, 0.0]
        d = np.diff(close, prepend=s[0])
        ema, up, dn = carried_mean(close, s[1], self.a), carried_mean(np.maximum(d, 0), s[2], self.b), carried_mean(np.maximum(-d, 0), s[3], self.b)
        pv, v = s[4] + np.cumsum(close * volume), s[5] + np.cumsum(volume)
        with np.errstate(divide="ignore", invalid="ignore"):
            rsi = np.where(dn == 0, np.where(up == 0, np.nan, 100.0), 100.0 - 100.0 / (1.0 + up / dn))
            vwap = np.where(v != 0, pv / v, np.nan)
        self.state.update(tuple(float(z[-1]) for z in (close, ema, up, dn, pv, v)))
        none = lambda z: pd.Series(z).astype(object).where(~np.isnan(z), None)
        yield pd.DataFrame({"ticker": key[0], "ts": pd.to_datetime(x["ts"]), "ema": ema, "rsi": none(rsi), "vwap": none(vwap)})

    def close(self) -> None:
        pass


def running_indicators(bars: DataFrame, span: int = 20, period: int = 14) -> DataFrame:
    """Bars (ticker, ts, close, volume) in time order -> the same values as the batch scan."""
    return bars.select("ticker", "ts", "close", "volume").groupBy("ticker").transformWithStateInPandas(
        RunningIndicators(span, period), "ticker STRING, ts TIMESTAMP, ema DOUBLE, rsi DOUBLE, vwap DOUBLE", "Append", "None")


def upsert_batches(stream: DataFrame, folder: str, checkpoint: str, key: list[str]):
    """Write each micro-batch by day with dynamic overwrite, merged by ``key`` with what is stored of its days: a day may come in parts."""
    from barflow.sources.writers import merge_days
    return stream.writeStream.foreachBatch(lambda df, _: merge_days(df, folder, key)).option("checkpointLocation", checkpoint)


class LateSplit(StatefulProcessor):
    """Marks rows that come more than ``delay`` behind the newest time that earlier batches of their key have brought. One time of state per key; a timer
    drops it when the watermark says that the key has been silent for ``keep``."""

    def __init__(self, delay: str, keep: str, cols: list[str]):
        self.delay, self.keep, self.cols = pd.Timedelta(delay), pd.Timedelta(keep).value // 1_000_000, cols

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "ts TIMESTAMP")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = pd.Timestamp(self.newest.get()[0]) if self.newest.exists() else None
        high = mark
        for frame in rows:
            ts = pd.to_datetime(frame["ts"])
            high = ts.max() if high is None else max(high, ts.max())
            yield frame[self.cols].assign(late=False if mark is None else (ts < mark - self.delay).to_numpy())
        if high != mark:
            self.newest.update((high.to_pydatetime(),))
            self.handle.registerTimer(high.value // 1_000_000 + self.keep)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.newest.exists() and _ns(self.newest.get()[0]) // 1_000_000 + self.keep <= expiredTimerInfo.getExpiryTimeInMs():
            self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


def mark_late(rows: DataFrame, key: str = "ticker", delay: str = "10 minutes", keep: str = "168 hours") -> DataFrame:
    """Rows of a stream (``key``, ts, ...) with ``late``: those more than ``delay`` behind are counted instead of dropped. ``keep`` is the retention: only rows
    that far behind the newest of all keys are dropped, and the state of a key that is silent for so long ends."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.withWatermark("ts", keep).groupBy(key).transformWithStateInPandas(
        LateSplit(delay, keep, rows.columns), f"{fields}, late BOOLEAN", "Append", "EventTime")


def split_to_files(marked: DataFrame, folder: str, key: str = "ticker") -> tuple[DataFrame, DataFrame]:
    """Drain a stream of ``mark_late`` into two tables under ``folder``: the rows in time, and a count of late ones by ``key`` and hour, per batch. A
    batch that is replayed overwrites its own files. Returns both tables, over all calls with this folder."""
    plain = marked.drop("late").schema
    counts = f"`{key}` {plain[key].dataType.simpleString()}, hour TIMESTAMP, rows BIGINT, oldest TIMESTAMP"

    def put(df: DataFrame, batch: int) -> None:
        df = df.persist()
        df.filter(~c("late")).drop("late").write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")
        df.filter("late").groupBy(key, F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("oldest")) \
            .write.mode("overwrite").parquet(f"{folder}/late/batch={batch}")
        df.unpersist()

    marked.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/chk").trigger(availableNow=True).start().awaitTermination()
    read = marked.sparkSession.read
    return read.schema(plain).parquet(f"{folder}/rows"), read.schema(counts).parquet(f"{folder}/late")


class Retained(StatefulProcessor):
    """Keeps the bars of the last ``hours`` of each ticker. An event-time timer per hour of bars takes them out when the watermark says that they
    are too old, so the state is bounded by the hours and the bars of one hour."""

    HOUR = 3_600_000

    def __init__(self, hours: int):
        self.keep = hours * self.HOUR

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars = handle.getMapState("bars", "ms BIGINT", "close DOUBLE")

    def _out(self, key, ms: int) -> pd.DataFrame:
        close = [v[0] for v in self.bars.values()]
        return pd.DataFrame({"ticker": [key[0]], "at": pd.to_datetime([ms], unit="ms"), "bars": [len(close)], "high": [max(close, default=None)],
                             "low": [min(close, default=None)]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old, newest = timerValues.getCurrentWatermarkInMs() - self.keep, 0
        for frame in rows:
            ms = frame["ts"].to_numpy("datetime64[ms]").astype(np.int64)
            for hour in np.unique(ms // self.HOUR).tolist():
                if (hour + 1) * self.HOUR > old:
                    self.handle.registerTimer((hour + 1) * self.HOUR + self.keep)
            for t, x in zip(ms.tolist(), frame["close"].tolist()):
                if (t // self.HOUR + 1) * self.HOUR > old:
                    self.bars.updateValue((t,), (x,))
            newest = max(newest, int(ms.max()))
        yield self._out(key, newest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs() - self.keep
        for k in [k for k in self.bars.keys() if k[0] < end]:
            self.bars.removeKey(k)
        yield self._out(key, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def retained(bars: DataFrame, hours: int = 168, late: str = "10 minutes") -> DataFrame:
    """Bars (ticker, ts, close) -> after each batch and each hour that ends: number, highest and lowest close of the bars kept (``hours``, whole hours)."""
    return bars.select("ticker", "ts", "close").withWatermark("ts", late).groupBy("ticker").transformWithStateInPandas(
        Retained(hours), "ticker STRING, at TIMESTAMP, bars BIGINT, high DOUBLE, low DOUBLE", "Append", "EventTime")


def evaluate_predictions(preds: DataFrame, bars: DataFrame, horizon: str = "1 hour", slack: str = "15 minutes", late: str = "30 minutes",
                         keep: tuple[str, ...] = ()) -> DataFrame:
    """Predictions (ticker, ts, price, ``keep``) against the bars from their time + horizon to + slack, as an outer interval join: one row ``evaluated`` per bar
    met, and one ``expired`` when the watermark has passed the interval without any. A prediction that is in neither is still pending
    (``lifecycle``); the state of both sides ends with the watermark.

    Both sides meet by ticker and stretch of the clock as long as the slack: an interval begins in one stretch and ends in it or the next, so a bar
    goes to its own stretch and the one before, and a prediction to one. Rows of a ticker spread over tasks and meet near ones only."""
    step = pd.Timedelta(slack).value // 1000
    slot = lambda x, off=0: F.floor((F.unix_micros(x) + off) / step)
    p = preds.withWatermark("ts", late).select(c("ticker").alias("p_ticker"), c("ts").alias("p_ts"), slot("ts", pd.Timedelta(horizon).value // 1000).alias("p_slot"), "price", *keep)
    b = bars.withWatermark("ts", late).select("ticker", "ts", "close", F.explode(F.array(slot("ts"), slot("ts") - 1)).alias("slot"))
    on = F.expr(f"ticker = p_ticker AND slot = p_slot AND ts >= p_ts + INTERVAL {horizon} AND ts < p_ts + INTERVAL {horizon} + INTERVAL {slack}")
    return p.join(b, on, "leftOuter").select(
        c("p_ticker").alias("ticker"), "p_ts", *keep, "ts", (div(c("close") - c("price"), c("price")) * 100).alias("actual_pct"),
        F.when(c("ts").isNull(), "expired").otherwise("evaluated").alias("status"))


def lifecycle(preds: DataFrame, outcomes: DataFrame, key: list[str]) -> DataFrame:
    """Every prediction of a table with its rows of ``evaluate_predictions`` (written by the stream), or ``pending``."""
    out = outcomes.select(*key, c("ts").alias("bar_ts"), "actual_pct", "status")
    return preds.join(out, key, "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def outcomes(preds: DataFrame, bars: DataFrame, horizon: str = "1 hour", slack: str = "15 minutes", late: str = "30 minutes",
             keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``evaluate_predictions`` for the tables that a stream has written so far, and one ``pending`` for each prediction that is neither evaluated nor
    behind the watermark (``late`` before the newest prediction or bar, whichever is older).

    A prediction meets every bar of its interval, so pairs grow with the square of what a stretch of the clock holds. They are made while the result is read
    and stored nowhere: the stream writes each row once, and the join deals each prediction once and each bar twice, by ticker and stretch."""
    end = c("p_ts") + F.expr(f"INTERVAL {horizon} + INTERVAL {slack}")
    newest = preds.agg(F.max("ts").alias("_p")).crossJoin(bars.agg(F.max("ts").alias("_b"))).select((F.least("_p", "_b") - F.expr(f"INTERVAL {late}")).alias("_mark"))
    out = evaluate_predictions(preds, bars, horizon, slack, late, keep).crossJoin(F.broadcast(newest))
    behind = F.coalesce(end < c("_mark"), F.lit(False))
    return out.withColumn("status", F.when((c("status") == "expired") & ~behind, "pending").otherwise(c("status"))).drop("_mark")


def run_to_files(stream: DataFrame, folder: str) -> DataFrame:
    """Drain the input once, append to Parquet under ``folder`` and return the written table."""
    q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out") \
        .option("checkpointLocation", f"{folder}/chk").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
