"""The block cut must not change any result: whole series (one block) against many small blocks, and against pandas."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barflow.operators import indicators as I, series as S
from barflow.plans import indicator_queries

c = F.col


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(7)
    frames = []
    for t, n in (("A", 3000), ("B", 700), ("C", 1)):
        close = 100 + np.cumsum(rng.normal(0, 1, n))
        gap = np.cumsum(rng.integers(1, 6, n))
        frames.append(pd.DataFrame({
            "ticker": t, "ts": pd.Timestamp("2000-01-01") + pd.to_timedelta(gap, "D"), "open": close + rng.normal(0, .5, n),
            "high": close + 2, "low": close - 2, "close": close, "volume": rng.integers(1, 99, n).astype(float)}))
    return pd.concat(frames, ignore_index=True)


def run(df):
    df = I.add_change(df)
    df = S.ewm(df, {"e5": (c("close"), S.span(5), False), "e20": (c("close"), S.span(20), False), "a9": (c("close"), S.span(9), True)})
    df = I.add_macd(df)
    df = I.add_obv(df)
    df = df.withColumns({"m20": S.mean(c("close"), 20), "next3": S.lead("close", 3), "mx": F.max("high").over(S.ahead(1, 5))})
    df = I.add_running_vwap(df)
    return S.unblock(df.withColumn("pos", c(S.POS))).orderBy("ticker", "ts").toPandas()


def test_blocks_do_not_change_results(spark, walk):
    bars = spark.createDataFrame(walk)
    one = run(S.blocked(bars, carry=I.vwap_carry(), block_rows=100000, small_bytes=0))
    many = run(S.blocked(bars, carry=I.vwap_carry(), halo=700, ahead=64, block_rows=900, bucket_rows=16, small_bytes=0))
    small = run(S.blocked(bars, carry=I.vwap_carry(), small_bytes=1 << 40))
    assert len(one) == len(many) == len(small) == len(walk)
    for other in (many, small):
        for x in one.columns:
            if one[x].dtype.kind == "f":
                np.testing.assert_allclose(other[x], one[x], rtol=1e-9, atol=1e-7, err_msg=x)
            else:
                assert (other[x] == one[x]).all(), x


def test_against_pandas(spark, walk):
    got = run(S.blocked(spark.createDataFrame(walk), carry=I.vwap_carry(), halo=700, ahead=64, block_rows=900, bucket_rows=16, small_bytes=0))
    for t, g in walk.sort_values("ts").groupby("ticker"):
        r = got[got.ticker == t]
        x = g.close
        pd.testing.assert_series_equal(r.e20.reset_index(drop=True), x.ewm(span=20, adjust=False).mean().reset_index(drop=True), check_names=False)
        pd.testing.assert_series_equal(r.a9.reset_index(drop=True), x.ewm(span=9).mean().reset_index(drop=True), check_names=False)
        pd.testing.assert_series_equal(r.m20.astype(float).reset_index(drop=True), x.rolling(20).mean().reset_index(drop=True), check_names=False)
        obv = (np.sign(x.diff()).fillna(0) * g.volume).cumsum()
        np.testing.assert_allclose(r.obv, obv)
        assert list(r.pos) == list(range(len(g)))


def test_later_bars_do_not_change_earlier_rows(spark, walk):
    cut = walk[walk.ts < walk.ts.max() - pd.Timedelta(days=4000)]
    full, part = (S.unblock(I.add_macd(I.add_rsi_wilder(I.add_change(S.blocked(spark.createDataFrame(x))), 14))).toPandas() for x in (walk, cut))
    m = part.merge(full, on=["ticker", "ts"], suffixes=("", "_f"))
    assert len(m) == len(part)
    np.testing.assert_allclose(m.macd_hist, m.macd_hist_f, atol=1e-9)
    np.testing.assert_allclose(m.rsi.astype(float), m.rsi_f.astype(float), atol=1e-9)


def test_constant_series_gives_nulls(spark):
    n = 40
    df = pd.DataFrame({"ticker": "K", "ts": pd.date_range("2020-01-01", periods=n), **{x: 5.0 for x in ("open", "high", "low", "close", "volume")}})
    out = I.add_stochastic(I.add_bollinger(I.add_rsi_sma(I.add_change(S.blocked(spark.createDataFrame(df))), 14)))
    row = S.unblock(out).orderBy(c("ts").desc()).first()
    assert row.rsi is None and row.bb_pos is None and row.stoch_k is None


def test_hot_ticker_is_split(spark):
    n = 5000
    df = pd.DataFrame({"ticker": "HOT", "ts": pd.date_range("2000-01-01", periods=n), **{x: np.arange(n) + 1.0 for x in ("open", "high", "low", "close", "volume")}})
    b = S.blocked(spark.createDataFrame(df), halo=100, ahead=10, block_rows=600, bucket_rows=16, small_bytes=0)
    sizes = [r["count"] for r in b.groupBy("ticker", S.BLK).count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 900


def test_a_window_beyond_the_halo_raises(spark):
    df = pd.DataFrame({"ticker": "A", "ts": pd.date_range("2000-01-01", periods=3000, freq="D"), "close": np.arange(3000.0)})
    for small in (0, 1 << 40):
        b = S.blocked(spark.createDataFrame(df), halo=200, ahead=10, block_rows=600, bucket_rows=16, small_bytes=small)
        assert S.unblock(b.withColumn("x", F.avg("close").over(S.w(200)))).count() == 3000
        with pytest.raises(ValueError, match="-399"):
            S.unblock(b.withColumn("x", F.avg("close").over(S.w(400))))
        with pytest.raises(ValueError, match="11"):
            S.unblock(b.withColumn("x", S.lead("close", 11)))
        with pytest.raises(ValueError, match="-399"):      # the output of the registered queries is guarded too
            indicator_queries.out(b.withColumn("x", F.avg("close").over(S.w(400))), "x")
        with pytest.raises(ValueError, match="forget"):
            S.ewm(b, {"x": (F.col("close"), S.span(50), False)})


@pytest.mark.parametrize("cut", [False, True])
def test_sliding_windows_agree_with_frames(spark, cut):
    """Long windows from running sums: a large level, small changes, gaps of NULL, cut blocks and whole ones."""
    rng = np.random.default_rng(12)
    n = 3000
    x = 1e6 + rng.normal(size=n)
    pdf = pd.DataFrame({"ticker": "T", "ts": pd.date_range("2024-01-01", periods=n, freq="15min"), "x": x})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(F.col("x") > 1e6 - 1.5, F.col("x")))
    df = S.blocked(df, 900, halo=700, block_rows=1500, bucket_rows=16, small_bytes=0, ahead=0) if cut else S.blocked(df, 900)
    specs = {"m": (F.col("x"), 500, 1, "mean"), "s": (F.col("x"), 300, 0, "std"), "short": (F.col("x"), 2, 3, "mean")}
    got = S.unblock(S.sliding(df, specs)).toPandas().sort_values("ts")
    v = got.x
    for name, want in (("m", v.shift(1).rolling(500, min_periods=1).mean()), ("s", v.rolling(300, min_periods=2).std()), ("short", v.shift(3).rolling(2, min_periods=1).mean())):
        np.testing.assert_allclose(got[name].to_numpy(float), want.to_numpy(float), rtol=1e-9)
    with pytest.raises(ValueError):
        S.sliding(df, {"m": (F.col("x"), 9000, 0, "mean")})


def test_tasks_grow_with_the_table(spark, tmp_path, monkeypatch):
    """The windows over the blocks run in as many tasks as the table's size asks for; a join's product does not count."""
    rng = np.random.default_rng(5)
    rows = pd.DataFrame([dict(ticker=f"T{k}", ts=pd.Timestamp("2020-01-01") + pd.Timedelta(days=i), close=float(rng.random())) for k in range(40) for i in range(50)])
    spark.createDataFrame(rows).write.parquet(f"{tmp_path}/bars")
    bars = spark.read.parquet(f"{tmp_path}/bars")
    size = S.plan_bytes(bars)
    assert S.task_count(bars, size // 20) in (20, 21)
    assert S.task_count(bars.alias("a").join(bars.alias("b"), F.expr("a.ticker = b.ticker")), size) <= 2
    want = S.unblock(S.ewm(S.blocked(bars), {"e": (F.col("close"), 0.1, False)}))
    monkeypatch.setattr(S, "TASK_BYTES", size // 20)
    for small in (S.SMALL_BYTES, 0):
        got = S.unblock(S.ewm(S.blocked(bars, small_bytes=small), {"e": (F.col("close"), 0.1, False)}))
        assert got.rdd.getNumPartitions() in (20, 21)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_short_clock_needs_no_cut(spark, walk, monkeypatch):
    """A large table whose first and last time are close is one block per ticker and goes through one shuffle; a longer clock is cut as before, with equal values."""
    bars = spark.createDataFrame(walk)
    monkeypatch.setattr(S, "SMALL_BYTES", 0)
    days = int((walk.ts.max() - walk.ts.min()).days)
    got = {}
    for rows in (days, days - 1):
        b = S.blocked(S.spanned(bars, bars), carry=I.vwap_carry(), halo=700, ahead=64, block_rows=rows, bucket_rows=16, small_bytes=0)
        assert S.one_block(b) == (rows == days)
        got[rows] = run(b)
    shuffles = S.blocked(S.spanned(bars, bars), small_bytes=0)._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert shuffles == 1 and "span_s" not in bars.schema["ts"].metadata
    pd.testing.assert_frame_equal(got[days], got[days - 1], rtol=1e-9, check_exact=False)
