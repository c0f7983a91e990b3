"""Row windows by numpy against Spark's own frames: many short batches, NULLs, cut blocks; and the shape of the plans that use them."""
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barflow.operators import alerts as A, frames, indicators as I, models as M, scanners as C, series as S

c = F.col


@pytest.fixture
def bars(spark):
    rng = np.random.default_rng(3)
    parts = []
    for t, n in (("A", 2000), ("B", 150), ("C", 1)):
        x = 50 + np.round(np.cumsum(rng.normal(0, 1, n)), 1)
        parts.append(pd.DataFrame({"ticker": t, "ts": pd.date_range("2020-01-01", periods=n), "open": x, "high": x + 1, "low": x - 1, "close": x, "volume": rng.integers(1, 9, n) * 1.0}))
    df = spark.createDataFrame(pd.concat(parts, ignore_index=True))
    return df.withColumn("gappy", F.when(F.dayofmonth("ts") > 2, c("close")))


def cut(bars):
    return S.blocked(bars, halo=700, ahead=8, block_rows=900, bucket_rows=16, small_bytes=0)


@pytest.mark.parametrize("blocks", [S.blocked, cut])
def test_frames_agree_with_spark_windows(spark, bars, blocks):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = blocks(bars)
        for x in ("close", "gappy"):
            own = {"mean": ("mean", x, 12), "std": ("std", x, 12), "std_pop": ("std_pop", x, 5), "min": ("min", x, 9), "max": ("max", x, 9), "lag": ("lag", x, 20),
                   "skipped": ("some_mean", x, 4, 3), "top": ("some_max", x, 3, 1), "rank": ("rank", x, 11), "mad": ("mad", x, 6), "double": ("mean", c(x) * 2, 3)}
            want = I.add_percent_rank(df, x, 11, "w_rank").withColumns({
                "w_mean": S.mean(c(x), 12), "w_std": S.std(c(x), 12), "w_std_pop": S.std(c(x), 5, 0), "w_min": S.full(F.min(x), c(x), 9), "w_max": S.full(F.max(x), c(x), 9),
                "w_lag": S.lag(x, 20), "w_skipped": F.avg(x).over(S.w(4, 3)), "w_top": F.max(x).over(S.w(3, 1)), "w_double": S.mean(c(x) * 2, 3),
                "_m": S.mean(c(x), 6), "_l": F.collect_list(x).over(S.w(6))})
            want = want.withColumn("w_mad", F.when(c("_m").isNotNull(), F.aggregate("_l", F.lit(0.0), lambda a, v: a + F.abs(v - c("_m"))) / 6))
            if x == "close":
                own |= {"ewm": ("ewm", x, S.span(26)), "ewm_before": ("ewm_adjusted", x, S.span(9), 1)}
                want = S.ewm(want, {"w_ewm": (c(x), S.span(26), False), "_e": (c(x), S.span(9), True)}).withColumn("w_ewm_before", S.lag("_e"))
            got = S.unblock(frames.add(df, own)).toPandas().merge(S.unblock(want).select("ticker", "ts", *[f"w_{k}" for k in own]).toPandas(), on=["ticker", "ts"])
            assert len(got) == 2151
            for k in own:
                np.testing.assert_allclose(got[k].to_numpy(float), got[f"w_{k}"].to_numpy(float), rtol=1e-12 if not k.startswith("ewm") else 1e-9, err_msg=f"{k} of {x}")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_frame_beyond_the_halo_raises(bars):
    with pytest.raises(ValueError, match="700"):
        frames.add(cut(bars), {"x": ("mean", "close", 702)})


@pytest.mark.parametrize("model", ["reversion", "extreme"])
def test_reversion_models_sort_the_bars_once(spark, bars, model):
    """F16, F18: no window adds up its rows again for every bar, and no projection is a method that the JVM leaves uncompiled (8,000 bytes)."""
    df = C.reversion_model(S.blocked(bars)) if model == "reversion" else M.extreme_reversion(bars)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("ticker", "ts", "signal")
        plan = df._jdf.queryExecution().executedPlan()
        text = plan.treeString(True, False, 2**31 - 1, False, False)
        assert not re.search(r"specifiedwindowframe\(RowFrame, -[2-9]", text) and text.count("Window [") <= 5
        code = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenString(plan)
        assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_alert_features_are_those_of_the_bundles(spark, bars):
    """the values the rules read, without a frame of up to 252 rows per bar and without the level of OBV."""
    slow, fast = A.slow_features(bars), A.fast_features(bars, S.DAY)
    for got, want, skip in ((slow, I.daily_bundle(bars, obv=False), ("p_ema_20", "p_ema_50", "range_5", "range_20", "bars")),
                            (fast, I.add_slopes(I.hourly_bundle(bars, S.DAY)), ("p_high", "p_volume", "bars"))):
        text = got._jdf.queryExecution().optimizedPlan().treeString(True, False, 2**31 - 1, False, False)
        assert not re.search(r"specifiedwindowframe\(RowFrame, -[2-9]", text) and text.count("Window [") <= 4
        names = [x for x in got.columns if x not in skip and x not in ("ticker", "ts")]
        both = got.toPandas().merge(S.unblock(want).select("ticker", "ts", *names).toPandas(), on=["ticker", "ts"], suffixes=("", "_w"))
        assert len(both) == 2151
        for x in names:
            np.testing.assert_allclose(both[x].to_numpy(float), both[f"{x}_w"].to_numpy(float), rtol=1e-9, atol=1e-9, err_msg=x)
