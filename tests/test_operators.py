"""Small hand-made cases and brute-force comparisons."""
import itertools
import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barflow.operators import candles as K, clean as C, ensemble as E, evaluate as V, indicators as I, joins as J, knn as N, mentions as M, quantiles as U, series as S

c = F.col


def bars_of(rows, ticker="T"):
    """rows of (open, high, low, close)."""
    return pd.DataFrame([dict(ticker=ticker, ts=pd.Timestamp("2020-01-01") + pd.Timedelta(days=i), open=o, high=h, low=lo, close=x, volume=10.0)
                         for i, (o, h, lo, x) in enumerate(rows)])


def test_candle_flags(spark):
    rows = [(10, 11, 8, 9), (8.5, 12, 8, 11), (11, 11.02, 8, 10.9), (10, 14, 9.95, 10.2), (10, 12, 8, 10.01), (10, 12, 9, 11), (11, 13, 10, 12), (12, 14, 11, 13)]
    f = S.unblock(K.add_daily_candles(S.blocked(spark.createDataFrame(bars_of([tuple(map(float, r)) for r in rows]))))).orderBy("ts").collect()
    assert f[1].bull_engulf == 1 and f[0].bull_engulf == 0
    assert f[2].hammer_bar == 1 and f[3].shooting_star == 1 and f[4].doji == 1
    assert f[7].white_soldiers == 1 and f[6].white_soldiers == 1


def test_library_flags_have_61_names_and_stay_in_range(spark):
    rng = np.random.default_rng(1)
    x = 50 + np.cumsum(rng.normal(0, 1, 400))
    o = x + rng.normal(0, 1, 400)
    rows = list(zip(o, np.maximum(o, x) + rng.random(400), np.minimum(o, x) - rng.random(400), x))
    df = K.candle_library(S.blocked(spark.createDataFrame(bars_of(rows)))).toPandas()
    names = K.library_names()
    assert len(names) == len(set(names)) >= 60
    assert set(np.unique(df[names].to_numpy())) <= {-1, 0, 1}
    assert (df[["cdl_doji", "cdl_engulfing", "cdl_spinning_top"]] != 0).any().all()


def test_library_flags_share_their_window_functions(spark):
    """a value of an earlier bar is one window function, however many flags mention it, and the flags are outside whole-stage code."""
    df = S.unblock(K.candle_library(S.blocked(spark.createDataFrame(bars_of([(10.0, 11.0, 8.0, 9.0)] * 20)))))
    plan = df._jdf.queryExecution().optimizedPlan().treeString(True, False, 2**31 - 1, False, False)
    assert plan.count("windowspecdefinition") < 60
    lines = df._jdf.queryExecution().executedPlan().treeString(True, False, 2**31 - 1, False, False).split("\n")
    assert not any("*(" in x.split("Project", 1)[0] for x in lines if "Project [" in x and "AS cdl_doji#" in x)
    e = K.library_events(K.candle_library(S.blocked(spark.createDataFrame(bars_of([(10.0, 11.0, 8.0, 9.0)] * 14 + [(9.0, 9.05, 8.95, 9.0)]))))).filter("pattern = 'cdl_doji'").collect()
    assert [(x.value, x.price, x.high, x.low) for x in e] == [(1, 9.0, 9.05, 8.95)]


@pytest.mark.parametrize("path,status", [
    ([(105, 99), (121, 110)], "hit_target"), ([(105, 99), (106, 79)], "hit_stop"), ([(105, 99), (125, 75)], "hit_stop"),
    ([(105, 99), (106, 95)], "triggered"), ([(101, 99), (102, 98)], "expired"), ([(101, 70), (105, 90)], "triggered"), ([(105, 70), (130, 90)], "hit_stop")])
def test_trade_outcomes(spark, path, status):
    """Entry 104, stop 80, target 120; each pair is the (high, low) of a later day."""
    bars = pd.DataFrame([dict(ticker="T", ts=pd.Timestamp("2020-01-01") + pd.Timedelta(days=i), high=float(h), low=float(lo)) for i, (h, lo) in enumerate([(100, 99)] + path)])
    t = spark.createDataFrame(pd.DataFrame([dict(ticker="T", ts=pd.Timestamp("2020-01-01"), action="BUY", entry=104.0, stop_loss=80.0, target=120.0)]))
    out = V.trade_outcomes(t, spark.createDataFrame(bars), F.lit("2020-02-01").cast("timestamp"), 30 * S.DAY).first()
    assert out.status == status


@pytest.mark.parametrize("entry_day,touch_day,touch,status", [
    (1, 61, (121, 110), "hit_target"), (1, 61, (106, 79), "hit_stop"), (61, 4500, (121, 110), "hit_target"), (2000, 2000, (125, 75), "hit_stop"),
    (61, 62, (106, 99), "triggered")])
def test_trade_outcomes_to_the_end(spark, entry_day, touch_day, touch, status):
    """Entry 104, stop 80, target 120: a touch on day 61, or years later, counts."""
    rows = {0: (100, 99), entry_day: (105, 99), touch_day: touch}
    bars = pd.DataFrame([dict(ticker="T", ts=pd.Timestamp("2010-01-01") + pd.Timedelta(days=i), high=float(h), low=float(lo))
                         for i in range(touch_day + 3) for h, lo in [rows.get(i, (101, 99))]])
    t = spark.createDataFrame(pd.DataFrame([dict(ticker="T", ts=pd.Timestamp("2010-01-01"), action="BUY", entry=104.0, stop_loss=80.0, target=120.0)]))
    out = V.trade_outcomes(t, spark.createDataFrame(bars), F.lit("2024-02-01").cast("timestamp")).first()
    assert out.status == status
    assert out.trigger_ts == pd.Timestamp("2010-01-01") + pd.Timedelta(days=entry_day)


def test_a_day_in_two_batches_stays_whole(spark, tmp_path):
    from barflow.streaming import live as L
    rows = [(1, "2024-01-01 09:00:00", 1.0), (2, "2024-01-01 15:00:00", 2.0), (2, "2024-01-01 15:00:00", 3.0), (3, "2024-01-02 09:00:00", 4.0)]
    for k, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, "event_id long, ts string, price double").withColumn("ts", c("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in{k}")
        stream = spark.readStream.schema("event_id long, ts timestamp, price double").parquet(f"{tmp_path}/in{k}")
        L.upsert_batches(stream, f"{tmp_path}/out", f"{tmp_path}/chk{k}", ["event_id"]).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("event_id", "price", c("date").cast("string")).collect()
    assert sorted(map(tuple, got)) == [(1, 1.0, "2024-01-01"), (2, 3.0, "2024-01-01"), (3, 4.0, "2024-01-02")]


def test_arbitration_table(spark):
    rows = [dict(profile=p, ticker="T", ts=pd.Timestamp("2020-01-01"), momentum_signal=m, technical_signal=t, regime_score=s)
            for p, m, t, s in itertools.product(("NVDA", "MSFT"), (-1, 0, 1), (-1, 0, 1), (-0.8, 0.0, 0.8))]
    df = spark.createDataFrame(pd.DataFrame(rows)).withColumn("regime_label", F.when(c("regime_score") > 0.3, "trending").when(c("regime_score") < -0.3, "ranging").otherwise("uncertain"))
    for r in E.combine(df, E.profiles(spark)).collect():
        m, t, reg = r.momentum_signal, r.technical_signal, r.regime_label
        if m == t and m != 0:
            assert (r.signal, r["size"]) == (m, r.full)
        elif r.version == 1 and m and t:
            want = {"trending": (m, r.half), "ranging": (t, r.half)}.get(reg)
            assert want is None or (r.signal, r["size"]) == want
        elif r.version == 1 and m:
            assert (r.signal, r["size"]) == {"trending": (m, r.half), "uncertain": (m, r.quarter), "ranging": (0, 0.0)}[reg]
        elif r.version == 1 and t:
            assert (r.signal, r["size"]) == {"ranging": (t, r.half), "uncertain": (t, r.quarter), "trending": (0, 0.0)}[reg]
        elif not m and not t:
            assert r.signal == 0


def test_strict_mentions(spark):
    texts = ["Look at $AAPL now", "(TSLA) and [MSFT] today", "I would buy NVDA here", "AMD 120c looks fine", "GME to the moon", "ticker: PLTR", "SPY fell 3% today",
             "ON the way UP", "buy ÉAMC"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    uni = spark.createDataFrame([(x,) for x in ("AAPL", "TSLA", "MSFT", "NVDA", "AMD", "GME", "PLTR", "SPY", "AMC")], "ticker string")
    got = {(r.id, r.ticker) for r in M.extract_strict(df, uni).collect()}
    assert got == {(0, "AAPL"), (1, "TSLA"), (1, "MSFT"), (2, "NVDA"), (3, "AMD"), (4, "GME"), (5, "PLTR"), (6, "SPY")}


def test_sentiment_and_slang(spark):
    df = spark.createDataFrame([("good gains but risk",), ("to the moon",), ("this is a scam, rekt",), ("nothing",)], "t string")
    got = [r.s for r in df.select(M.sentiment(c("t")).alias("s")).collect()]
    assert got == pytest.approx([(0.5 + 0.5 - 0.3) / 3, 0.6, -0.6, 0.0])


def test_quantiles_through_the_bracket(spark):
    rng = np.random.default_rng(3)
    x = pd.DataFrame({"k": np.where(np.arange(40000) % 3 == 0, "hot", "b"), "x": rng.normal(size=40000)})
    got = U.exact_quantiles(spark.createDataFrame(x), ["k"], "x", {"a": 0.33, "m": 0.5, "z": 0.9}).toPandas().set_index("k")
    for k, g in x.groupby("k"):
        np.testing.assert_allclose(got.loc[k], np.quantile(g.x, [0.33, 0.5, 0.9]), rtol=1e-12)


def test_hurst_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = 100 + np.cumsum(rng.normal(size=200))
    df = bars_of([(v, v + 1, v - 1, v) for v in x])
    got = S.unblock(I.add_hurst(S.blocked(spark.createDataFrame(df)))).orderBy("ts").toPandas().hurst
    assert (got[:120] == 0.5).all()
    w, lags = x[30:150], range(2, 60)
    tau = [math.sqrt(np.std(w[k:] - w[:-k])) for k in lags]
    assert got[150] == pytest.approx(2 * np.polyfit(np.log(list(lags)), np.log(tau), 1)[0])


def test_nearest_against_numpy(spark):
    rng = np.random.default_rng(9)
    close = 100 + np.cumsum(rng.normal(size=300))
    bars = bars_of([(v, v + 1, v - 1, v) for v in close])
    n, k = 20, 10
    got = N.cross_forecast(spark.createDataFrame(bars), n, k).first()
    def z(a):
        return (a - a.mean()) / a.std()
    q, w, lib = z(close[-n:]), np.array(N.exponential_weights(n)), []
    for i in range(len(close) - n - 19):
        now = close[i + n]
        lib.append((np.sqrt((w * (q - z(close[i:i + n])) ** 2).sum()), *[close[i + n + h] / now - 1 if i + n + h < len(close) else np.nan for h in (4, 12, 26)]))
    lib = np.array(sorted(lib))[:k]
    for j, h in enumerate(("h1", "h3", "eod"), 1):
        ok = ~np.isnan(lib[:, j])
        assert got[h] == pytest.approx((lib[ok, j] / (lib[ok, 0] + 1e-8)).sum() / (1 / (lib[ok, 0] + 1e-8)).sum())


def test_nearest_compares_few_and_loses_none(spark):
    """Lower bounds: fewer pairs compared, the same neighbours as by comparing all; several queries, weights, a scale, ties."""
    rng = np.random.default_rng(4)
    n, k = 12, 5
    walk = np.cumsum(rng.normal(size=(1500, n)), axis=1)
    shapes = (walk - walk.mean(1, keepdims=True)) / walk.std(1, keepdims=True)
    shapes[700:706] = shapes[3]            # ties
    t0 = pd.Timestamp("2021-01-01")
    lib = spark.createDataFrame(pd.DataFrame({"ticker": ["A"] * 1400 + ["B"] * 97 + ["C"] * 3, "ts": [t0 + pd.Timedelta(hours=7 * i) for i in range(1500)],
                                              "shape": list(shapes), "f": np.arange(1500) % 2 + 1.0}))
    ask = shapes[[3, 50, 1402, 1499]] + rng.normal(size=(4, n)) * [[0.0], [0.3], [0.1], [0.1]]
    q = spark.createDataFrame(pd.DataFrame({"ticker": ["A", "A", "B", "C"], "at": [1, 2, 3, 4], "query": list(ask)}))
    for weights, scale in ((None, None), (N.decay_weights(n), c("f"))):
        w = np.array(weights or [1.0] * n)
        got = N.nearest(lib, q, k, n, weights, by=("ticker", "at"), scale=scale, interval_s=900).collect()
        for at, (x, part) in enumerate(zip(ask, (slice(0, 1400), slice(0, 1400), slice(1400, 1497), slice(1497, 1500))), 1):
            d = np.sqrt((w * (shapes[part] - x) ** 2).sum(1)) * (np.arange(1500)[part] % 2 + 1 if scale is not None else 1)
            want = sorted(zip(d, range(len(d))))[:k]
            mine = sorted([r for r in got if r.at == at], key=lambda r: (r.dist, r.ts))
            assert [(r.ts - t0) // pd.Timedelta(hours=7) - part.start for r in mine] == [i for _, i in want]
            assert [r.dist for r in mine] == pytest.approx([x for x, _ in want]) and {r.library_size for r in mine} == {len(d)}
    some = {r.at: r for r in N.pruning(lib, q, k, n, by=("ticker", "at")).collect()}
    assert some[1].pairs == 1400 and some[1].compared < 400 and some[2].compared < 700 and some[4].compared == 3


def test_asof_over_blocks(spark):
    """Long gaps: the value known before and after is carried over blocks of buckets without bars."""
    rng = np.random.default_rng(2)
    t0 = pd.Timestamp("2020-01-01")
    days = sorted({int(x) for x in np.concatenate([rng.integers(0, 40, 25), rng.integers(900, 910, 6), [2000, 5000]])})
    bars = pd.DataFrame([(t, t0 + pd.Timedelta(days=d), float(d)) for t in ("T", "U") for d in days if t == "T" or d % 2], columns=["ticker", "ts", "close"])
    at = [(t, t0 + pd.Timedelta(hours=int(h))) for t in ("T", "U", "none") for h in rng.integers(-2000, 130_000, 150)]
    p = pd.DataFrame([(t, i, a) for i, (t, a) in enumerate(at)], columns=["ticker", "id", "at"])
    for d in ("forward", "backward", "nearest"):
        got = J.asof_join(spark.createDataFrame(p), spark.createDataFrame(bars), "at", ["close"], d, S.DAY, bucket_rows=4, block=8)
        got = got.select("id", c("hit.close").alias("x")).toPandas().set_index("id").x
        want = pd.merge_asof(p.sort_values("at"), bars.sort_values("ts"), left_on="at", right_on="ts", by="ticker", direction=d).set_index("id").close
        pd.testing.assert_series_equal(got.astype(float).sort_index(), want.sort_index(), check_names=False)


def test_asof_with_one_hot_bucket(spark):
    """A third of the probes in one bucket, probes before the first and after the last bar."""
    bars = bars_of([(i, i + 1, i - 1, float(i)) for i in range(100)])[::3]
    t0 = pd.Timestamp("2020-01-01")
    at = [t0 - pd.Timedelta(days=5), t0 + pd.Timedelta(days=400)] + [t0 + pd.Timedelta(hours=7 * i) for i in range(200)] + [t0 + pd.Timedelta(days=10.5)] * 100
    p = spark.createDataFrame(pd.DataFrame({"ticker": "T", "id": range(len(at)), "at": at}))
    b = spark.createDataFrame(bars)
    ref = pd.DataFrame({"at": at, "id": range(len(at))}).sort_values("at")
    for d in ("forward", "backward", "nearest"):
        got = J.asof_join(p, b, "at", ["close"], d, S.DAY, bucket_rows=8).select("id", c("hit.close").alias("x")).toPandas().set_index("id").x
        want = pd.merge_asof(ref, bars[["ts", "close"]], left_on="at", right_on="ts", direction=d).set_index("id").close
        pd.testing.assert_series_equal(got.astype(float).sort_index(), want.sort_index(), check_names=False)


def test_parse_time(spark):
    t = ["2024-05-01T10:11:12Z", "2024-05-01 10:11:12", "5/1/2024 10:11:12", "5/1/2024 10:11", "2024-05-01", "1714558272", "soon", None]
    got = [r.x for r in spark.createDataFrame([(x,) for x in t], "t string").select(C.parse_time(c("t")).cast("timestamp_ntz").cast("string").alias("x")).collect()]
    assert got == ["2024-05-01 10:11:12"] * 3 + ["2024-05-01 10:11:00", "2024-05-01 00:00:00", "2024-05-01 10:11:12", None, None]


def test_empty_frame(spark):
    df = S.blocked(spark.createDataFrame(bars_of([(1., 1., 1., 1.)])).limit(0), small_bytes=0)
    assert S.unblock(I.add_macd(I.add_change(df))).count() == 0


def test_kelly_and_fixed_sizes(spark):
    row = dict(signal=1, confidence=0.8, entry_low=99.0, entry_high=101.0, stop_loss=95.0, atr=1.0, ticker="T")
    r = E.position_sizes(spark.createDataFrame(pd.DataFrame([row]))).first()
    assert r.fixed_shares == 250 and r.kelly_shares == 0 and r.volatility_shares == 180 and r.method == "fixed_risk" and r.shares == 250


def test_envelope_without_a_required_field_raises(spark, tmp_path):
    import json

    from barflow.sources.readers import read_envelope
    bar = {"timestamp": "2024-01-02 10:00:00", "Open": 1.0, "High": 2.0, "Low": 0.5, "Close": 1.5, "Volume": 10.0}
    (tmp_path / "good.json").write_text(json.dumps({"data": [bar] * 3}))
    (tmp_path / "bad.json").write_text(json.dumps({"data": [{k: v for k, v in bar.items() if k != "Low"}] * 3}))
    assert read_envelope(spark, str(tmp_path / "good.json"), "A", least=2).count() == 3
    with pytest.raises(Exception, match="required field Low"):
        read_envelope(spark, str(tmp_path / "bad.json"), "A", least=2).collect()
    (tmp_path / "one.json").write_text(json.dumps({"data": [bar, {**bar, "Close": None}, bar]}))
    with pytest.raises(Exception, match="A: 1 bars lack the required field Close"):
        read_envelope(spark, str(tmp_path / "one.json"), "A", least=2).collect()


def test_slang_matches_lower_cased_words(spark):
    from barflow.operators.mentions import sentiment
    df = spark.createDataFrame([("new ATH today",), ("YOLO",), ("a drug and a bath",), ("rug pull",)], "t string")
    assert [r[0] for r in df.select(sentiment(F.col("t"))).collect()] == [0.6, 0.6, 0.0, -0.6]


@pytest.mark.parametrize("n", [3, 40, 700, 20000])
def test_quantiles_with_ties(spark, n):
    from barflow.operators.quantiles import exact_quantiles
    x = np.where(np.arange(n) % 10 == 0, np.random.default_rng(n).normal(size=n), 0.0)
    got = exact_quantiles(spark.createDataFrame(pd.DataFrame({"k": "a", "x": x})), ["k"], "x", {"p3": 0.3, "p50": 0.5, "p97": 0.97}).collect()[0]
    assert np.allclose([got.p3, got.p50, got.p97], np.quantile(x, [0.3, 0.5, 0.97]), atol=1e-12)


def test_first_touches_share_a_short_tree(spark):
    """The tree ends at one node per ticker, and two levels are searched in one way up: same as the bars read one by one."""
    rng = np.random.default_rng(11)
    x = 100 + np.cumsum(rng.normal(0, 1, 700))
    bars = spark.createDataFrame(bars_of([(v, v + 1, v - 1, v) for v in x]))
    tree = J.touch_tree(bars, S.DAY)
    assert len(tree) == 2
    s = bars.withColumns({"hi": c("close") + 6, "lo": c("close") - 6})
    got = J.first_touches(s, tree, "ts", {"a": (F.lit(True), c("hi")), "b": (F.lit(False), c("lo"))}).orderBy("ts").collect()
    day = [r.ts for r in got]
    for i, r in enumerate(got):
        assert r.a == next((day[j] for j in range(i + 1, len(x)) if x[j] + 1 >= r.hi), None)
        assert r.b == next((day[j] for j in range(i + 1, len(x)) if x[j] - 1 <= r.lo), None)


def test_slope_of_a_balanced_obv_is_zero(spark):
    rng = np.random.default_rng(3)
    obv, x = rng.integers(-60, 60, 4000) * 1000 + 7, 50 + np.cumsum(rng.normal(0, 1, 4000))
    df = bars_of([(v, v, v, v) for v in x]).assign(obv=obv.astype(float))
    got = S.unblock(I.add_slopes(S.blocked(spark.createDataFrame(df)))).orderBy("ts").toPandas()
    weighted = -2 * obv[:-4] - obv[1:-3] + obv[3:-1] + 2 * obv[4:]
    assert (weighted == 0).sum() >= 5 and got.obv_slope[:4].isna().all() and got.price_slope[:4].isna().all()
    assert (np.sign(got.obv_slope[4:].to_numpy()) == np.sign(weighted)).all()
    assert np.allclose(got.obv_slope[4:], weighted / 10) and np.allclose(got.price_slope[4:], [np.polyfit(range(5), x[i:i + 5], 1)[0] for i in range(len(x) - 4)])


def test_asof_join_shares_its_shuffles(spark, tmp_path):
    """Both sides of the scan along tickers read the edges of the buckets from one shuffle of the bars."""
    pd.DataFrame({"ticker": ["A"] * 9, "ts": pd.date_range("2024-01-01", periods=9), "close": np.arange(9.0)}).to_parquet(tmp_path / "bars.parquet", coerce_timestamps="us")
    spark.createDataFrame([("A", pd.Timestamp("2024-01-03 15:00").to_pydatetime())], "ticker string, at timestamp_ntz").write.parquet(f"{tmp_path}/left")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        bars = spark.read.parquet(f"{tmp_path}/bars.parquet").groupBy("ticker", "ts").agg(F.max("close").alias("close"))
        got = J.asof_join(spark.read.parquet(f"{tmp_path}/left"), bars, "at", ["close"], "nearest", 86400)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("struct<ticker:string,ts:timestamp_ntz,close:double>") == 2
        assert got.first().hit.close == 3.0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_range_join_shuffles_no_arrays(spark, tmp_path):
    """Bars after a row against brute force, over several buckets and gaps; each side is shuffled once."""
    rng = np.random.default_rng(4)
    day = lambda n: pd.Timestamp("2020-01-01") + pd.to_timedelta(np.sort(rng.choice(900, n, False)), "D")
    bars = pd.concat([pd.DataFrame({"ticker": t, "ts": day(n), "high": rng.random(n)}) for t, n in (("A", 400), ("B", 9))], ignore_index=True)
    bars.to_parquet(tmp_path / "bars.parquet", coerce_timestamps="us")
    b = spark.read.parquet(f"{tmp_path}/bars.parquet")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for horizon, rows in ((60, 32), (60, 100), (1, 2)):
            got = J.bars_after(b.select("ticker", "ts"), ["ticker", "ts"], b, ["high"], horizon * 86400, bucket_rows=rows)
            assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 2
            for r in got.collect():
                same = bars[(bars.ticker == r.ticker) & (bars.ts > r.ts) & (bars.ts <= r.ts + pd.Timedelta(days=horizon))]
                assert [(x.ts, x.high) for x in r.future or []] == list(zip(same.ts, same.high))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_walk_forward_rows_that_know_their_start_stay(spark):
    """The rule of a window does not depend on how the ticker's first time is found; with it, rows are not dealt anew to look it up."""
    rng = np.random.default_rng(9)
    ts = pd.Timestamp("2020-01-01") + pd.to_timedelta(np.arange(300), "D")
    rows = pd.concat([pd.DataFrame({"ticker": t, "ts": ts, "feature": rng.normal(size=300), "next_ret": rng.normal(size=300) / 50, "next_ts": ts + pd.Timedelta(days=1)}) for t in "AB"])
    df = spark.createDataFrame(rows).withColumn("feature", F.when(F.dayofmonth("ts") != 7, c("feature")))
    known = df.withColumn("first_ts", F.lit(ts[0].to_pydatetime()).cast(df.schema["ts"].dataType))
    plan = V.fitted_signals(known, cost=0.001)
    want = V.fitted_signals(df, cost=0.001)
    assert "_salt" not in plan._jdf.queryExecution().analyzed().toString() and plan.columns == want.columns
    got, want = (sorted(map(tuple, x.select("ticker", "ts", "split", "signal").collect())) for x in (plan, want))
    assert got == want and {s for *_, s in got} == {-1, 0, 1} and len(got) == 480


@pytest.mark.parametrize("horizon", [None, 20])
def test_touches_in_one_pass_are_those_of_the_tree(spark, monkeypatch, horizon):
    """Bars on a short clock are searched in one sorted pass without joins or stored levels: the same outcomes, also for trades between bars, without a level,
    action, time or ticker, and for tickers without bars."""
    rng = np.random.default_rng(6)
    frames = []
    for t, n in (("A", 600), ("B", 40), ("C", 1)):
        close = 100 + np.cumsum(rng.normal(0, 1, n))
        day = pd.Timestamp("2020-01-01") + pd.to_timedelta(np.sort(rng.choice(700, n, False)), "D")
        frames.append(pd.DataFrame({"ticker": t, "ts": day, "high": close + 1, "low": close - 1, "close": close}))
    bars = pd.concat(frames, ignore_index=True)
    trades = bars.sample(300, random_state=1).reset_index(drop=True)
    trades["ts"] += pd.to_timedelta(rng.integers(-1, 2, 300) * 6, "h")
    buy, step = rng.random(300) < 0.5, rng.choice([1, 3, 9, 40], 300)
    sign = np.where(buy, 1, -1)
    trades = pd.DataFrame({"id": np.arange(300), "ticker": trades.ticker, "ts": trades.ts, "action": np.where(buy, "BUY", "SELL"), "entry": trades.close + sign,
                           "stop_loss": trades.close - sign * step, "target": trades.close + sign * step})
    df = spark.createDataFrame(trades).withColumns({
        "entry": F.when(c("id") % 31 != 0, c("entry")), "target": F.when(c("id") % 17 != 0, c("target")), "action": F.when(c("id") % 23 != 0, c("action")),
        "ts": F.when(c("id") % 41 != 0, c("ts")), "ticker": F.when(c("id") % 37 == 0, None).when(c("id") % 29 == 0, "D").otherwise(c("ticker"))})
    b, now = spark.createDataFrame(bars[["ticker", "ts", "high", "low"]]), F.lit("2022-01-01").cast("timestamp")
    seconds = horizon and horizon * 86400
    want = V.trade_outcomes(df, b, now, seconds)
    monkeypatch.setattr(S, "SMALL_BYTES", 0)
    got = V.trade_outcomes(df, S.spanned(b, b), now, seconds)
    assert not any(x.startswith("Join") for x in re.findall(r"\w+", got._jdf.queryExecution().optimizedPlan().toString()))
    assert sorted(got.columns) == sorted(want.columns) and got.schema["stop_ts"].dataType == want.schema["stop_ts"].dataType
    got, want = (sorted(map(tuple, x.collect())) for x in (got.select("id", "trigger_ts", "stop_ts", "target_ts", "status"), want.select("id", "trigger_ts", "stop_ts", "target_ts", "status")))
    assert got == want and {x[-1] for x in got} == {"triggered", "hit_target", "hit_stop", "expired"} | ({"pending"} if any(x[-1] == "pending" for x in want) else set())


def test_a_short_library_is_compared_where_it_lies(spark, monkeypatch):
    """The k nearest windows and the forecast are the same in one pass by ticker as by slices of the clock; no window is dealt by slices, and regimes join bare bars."""
    rng = np.random.default_rng(13)
    bars = pd.concat([pd.DataFrame({"ticker": t, "ts": pd.date_range("2020-01-01", periods=n), "close": 50 + np.cumsum(rng.normal(size=n))}) for t, n in (("A", 300), ("B", 60))])
    b = spark.createDataFrame(bars)
    regimes = b.filter(F.dayofmonth("ts") > 3).select("ticker", "ts", F.when(F.dayofmonth("ts") != 9, F.dayofmonth("ts") % 3).alias("regime"))
    monkeypatch.setattr(S, "SMALL_BYTES", 0)
    got = []
    for frame in (b, S.spanned(b, b)):
        lib = N.regime_library(frame, regimes, interval_s=S.DAY)
        queries = N.current_shape(N.last_bars(frame, 20), 20).withColumn("current_regime", F.lit(1))
        near = N.nearest(lib, queries, 5, 20, scale=1 / N.regime_similarity(0.7), interval_s=S.DAY)
        plan = near._jdf.queryExecution().analyzed().toString()
        assert ("_slice" in plan) == (frame is b) and plan.index("_known") > 0
        got.append((sorted((x.ticker, x.ts, round(x.dist, 9), x.library_size) for x in near.collect()), sorted(map(tuple, N.regime_forecast(lib, queries, 5, interval_s=S.DAY).collect())),
                    lib.count(), lib.filter("regime IS NULL").count()))
    assert got[0][0] == got[1][0] and len(got[0][0]) == 10 and got[0][2:] == got[1][2:] and got[0][3] > 0
    for x, y in zip(got[0][1], got[1][1]):
        assert x[0] == y[0] and [v for v in x[1:]] == pytest.approx([v for v in y[1:]])
