"""The caller's own models and scanners."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barflow.operators import ensemble as E, knn as N, plugins as P, series as S

c = F.col


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(6)
    frames = []
    for t, n in (("A", 2600), ("B", 300), ("C", 3)):
        x = 100 + np.cumsum(rng.normal(size=n))
        frames.append(pd.DataFrame({"ticker": t, "ts": pd.date_range("2024-01-01", periods=n, freq="15min"), "open": x, "high": x + 1, "low": x - 1,
                                    "close": x + rng.normal(size=n) / 3, "volume": rng.uniform(1, 9, n)}))
    return spark.createDataFrame(pd.concat(frames))


def crossing():
    """A caller's function, as one defined in a notebook would reach the workers."""
    def cross(frame: pd.DataFrame) -> pd.Series:
        fast, slow = frame.close.rolling(5, min_periods=1).mean(), frame.close.rolling(20, min_periods=1).mean()
        return np.sign(fast - slow)
    return cross


cross = crossing()


def test_python_model_over_cut_blocks(spark, bars, monkeypatch):
    """The same signals in blocks of a few hundred bars as over whole series."""
    whole = bars.toPandas().sort_values(["ticker", "ts"])
    want = whole.assign(want=whole.groupby("ticker", group_keys=False)[["close"]].apply(cross)).set_index(["ticker", "ts"]).want.astype(int)
    plain = S.blocked
    for cut in (False, True):
        if cut:
            monkeypatch.setattr(S, "blocked", lambda df, interval_s, **k: plain(df, interval_s, **{**k, "block_rows": 300, "bucket_rows": 16, "small_bytes": 0}))
        got = P.signals(P.python_model(cross, 40), bars).toPandas().set_index(["ticker", "ts"]).signal.sort_index()
        pd.testing.assert_series_equal(got, want.sort_index(), check_names=False, check_dtype=False)


def test_schema_is_checked(spark, bars):
    with pytest.raises(ValueError, match="volume"):
        P.signals(lambda b: b, bars.drop("volume"))
    with pytest.raises(ValueError, match=r"signal \(missing\)"):
        P.signals(lambda b: b, bars)
    with pytest.raises(ValueError, match=r"close \(string\)"):
        P.signals(lambda b: b, bars.withColumn("close", c("close").cast("string")))
    with pytest.raises(Exception, match="gave 1 values"):
        P.signals(P.python_model(lambda f: pd.Series([1]), 5), bars).collect()
    with pytest.raises(ValueError):
        P.python_model(cross, S.HALO_ROWS + 1)


def test_ensemble_takes_any_two_models(spark, bars):
    up = lambda b: b.select("ticker", "ts", F.lit(2.5).alias("signal"))
    rows = P.ensemble(bars, up, P.python_model(cross, 40), E.profiles(spark), F.when(c("ticker") == "A", "NVDA").otherwise("nobody")).collect()
    assert len(rows) == 2903 and {r.momentum_signal for r in rows} == {1} and {r.technical_signal for r in rows} <= {-1, 0, 1}
    assert all(r.adx_min == 30.0 and r.smoothing == 3 for r in rows)             # an unknown profile takes the first one's settings
    agree = [r for r in rows if r.technical_signal == 1]
    assert agree and all(r.signal == 1 and r["size"] == 1.0 for r in agree)


def test_fallback_where_a_ticker_has_no_signal(spark):
    """Every 13th bar from the 13th on, if its momentum is large enough; tickers with a signal of their own keep it."""
    t0 = pd.Timestamp("2024-01-01")
    rows = [(t, t0 + pd.Timedelta(minutes=15 * i), m, 1 if t == "B" and i == 3 else 0) for t in ("A", "B") for i, m in enumerate(np.tile([0.01, -0.01, 0.001], 14))]
    got = N.momentum_fallback(spark.createDataFrame(pd.DataFrame(rows, columns=["ticker", "ts", "mom", "signal"]))).collect()
    assert {(r.ticker, (r.ts - t0) // pd.Timedelta(minutes=15), r.signal) for r in got if r.signal} == {("A", 13, -1), ("A", 39, 1), ("B", 3, 1)}


def test_scanner_with_volume(spark, bars):
    scan = P.with_volume(lambda b: b.filter(c("close") > c("open") + 0.5).select("ticker", "ts", F.lit("pop").alias("pattern"), F.lit(0.9).alias("confidence")))
    out = scan(bars)
    n = bars.filter(c("close") > c("open") + 0.5).count()
    rows = out["patterns"].collect()
    assert len(rows) == n and all(0 <= r.volume_score <= 1 for r in rows)
    kept = [r for r in rows if r.volume_score >= 0.4 - 1e-9 and r.confidence >= 40]
    assert out["filtered"].count() == len(kept) and sum(r.patterns for r in out["summary"].collect()) == len(kept)
    with pytest.raises(ValueError, match="pattern"):
        P.with_volume(lambda b: b)(bars)
