"""Streams fed in parts: late rows, retention, the life of predictions, repeated alerts."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barflow.streaming import live as L

c = F.col
T0 = pd.Timestamp("2024-03-01")


@pytest.fixture(scope="module")
def spark(spark):
    L.use_rocksdb(spark)
    return spark


def feed(spark, folder, rows, cols):
    df = spark.createDataFrame(pd.DataFrame(rows, columns=cols))
    df.write.mode("append").parquet(folder)
    return df.schema


def at(hours):
    return T0 + pd.Timedelta(hours=hours)


def test_late_rows_are_counted_and_old_ones_dropped(spark, tmp_path):
    folder, cols = str(tmp_path / "in"), ["ticker", "ts", "price"]
    parts = [[("A", at(h), float(h)) for h in range(0, 100)] + [("B", at(3), 1.0)],
             [("A", at(97), -1.0), ("A", at(99.5), -2.0), ("A", at(60), -3.0), ("A", at(60.5), -4.0), ("A", at(1), -5.0), ("B", at(60), -6.0), ("A", at(101), 1.0)],
             [("A", at(99.7), -7.0), ("A", at(98.5), -8.0)]]
    for rows in parts:
        schema = feed(spark, folder, rows, cols)
        got, late = L.split_to_files(L.mark_late(spark.readStream.schema(schema).parquet(folder), "ticker", "2 hours", "50 hours"), str(tmp_path / "out"))
    # behind by more than two hours of what the batches before had brought; more than 50 hours behind everything: gone
    assert sorted((r.ticker, r.hour - T0, r.rows) for r in late.collect()) == [
        ("A", pd.Timedelta(hours=60), 2), ("A", pd.Timedelta(hours=98), 1)]
    assert got.where("price < 0").count() == 4 and got.count() == 106 and sorted(r.price for r in got.where("price < 0").collect()) == [-7.0, -6.0, -2.0, -1.0]


def test_retention_bounds_the_state(spark, tmp_path):
    folder, cols = str(tmp_path / "in"), ["ticker", "ts", "close"]
    for a in (0, 40, 80):
        schema = feed(spark, folder, [("A", at(h), float(h % 7)) for h in range(a, a + 40)], cols)
        out = L.run_to_files(L.retained(spark.readStream.schema(schema).parquet(folder), 24), str(tmp_path / "out"))
    rows = sorted((r["at"], r.bars, r.high, r.low) for r in out.collect())
    assert max(r[1] for r in rows) <= 24 + 2 + 40        # a batch beside what is kept, never the whole history
    last = [r for r in rows if r[0] <= at(118.9)][-1]
    kept = [float(h % 7) for h in range(120) if h + 1 + 24 > 118.8]
    assert min(r[1] for r in rows if r[0] > at(100)) == len(kept) and last[2:] == (max(kept), min(kept))


def test_predictions_expire_or_stay_open(spark, tmp_path):
    p_in, b_in = str(tmp_path / "p"), str(tmp_path / "b")
    preds = [("A", at(0), 100.0, 1), ("A", at(2), 100.0, 2), ("A", at(30), 100.0, 3), ("B", at(0), 50.0, 4)]
    bars = [("A", at(1.1), 110.0), ("A", at(1.2), 90.0), ("A", at(29.5), 1.0), ("B", at(2), 60.0), ("A", at(30.2), 5.0)]
    ps, bs = feed(spark, p_in, preds, ["ticker", "ts", "price", "id"]), feed(spark, b_in, bars, ["ticker", "ts", "close"])
    read = lambda s, f: spark.readStream.schema(s).parquet(f)
    run = lambda: L.run_to_files(L.evaluate_predictions(read(ps, p_in), read(bs, b_in), keep=("id",)), str(tmp_path / "out"))
    table = spark.read.schema(ps).parquet(p_in)
    state = lambda out: sorted((r.id, r.status, r.actual_pct) for r in L.lifecycle(table, out, ["ticker", "id"]).collect())
    assert state(run()) == [(1, "evaluated", -10.0), (1, "evaluated", 10.0), (2, "expired", None), (3, "pending", None), (4, "expired", None)]
    feed(spark, b_in, [("A", at(31.1), 103.0)], ["ticker", "ts", "close"])
    assert (3, "evaluated", pytest.approx(3.0)) in state(run())


def test_outcomes_of_tables_are_those_of_the_stream(spark, tmp_path):
    """Pairs made from the tables when they are read: the same rows and states, also where times repeat, at the watermark and for equal ids."""
    p_in, b_in = str(tmp_path / "p"), str(tmp_path / "b")
    preds = [("A", at(0), 100.0, 1), ("A", at(0), 50.0, 1), ("A", at(2), 100.0, 2), ("A", at(30), 100.0, 3), ("B", at(0), 50.0, 4), ("B", at(28.25), 50.0, 5), ("B", at(28.2), 50.0, 6)]
    bars = [("A", at(1), 110.0), ("A", at(1.25), 90.0), ("A", at(1.2), 90.0), ("A", at(1.2), 80.0), ("A", at(29.5), 1.0), ("B", at(2), 60.0), ("A", at(30.2), 5.0)]
    feed(spark, p_in, preds, ["ticker", "ts", "price", "id"]), feed(spark, b_in, bars, ["ticker", "ts", "close"])
    got = L.outcomes(spark.read.parquet(p_in), spark.read.parquet(b_in), keep=("id",)).collect()
    assert sorted((r.id, r.status, round(r.actual_pct, 6) if r.actual_pct is not None else 0) for r in got) == [
        (1, "evaluated", -20.0), (1, "evaluated", -10.0), (1, "evaluated", 10.0), (1, "evaluated", 60.0), (1, "evaluated", 80.0), (1, "evaluated", 120.0),
        (2, "expired", 0), (3, "pending", 0), (4, "expired", 0), (5, "pending", 0), (6, "expired", 0)]


def test_the_prediction_query_stores_no_pairs(spark):
    import glob
    import os
    import __spark_entry__ as entry
    from barflow.session import shared_dir
    sf = "/root/testdata/sf0.001"
    rows = entry.queries()["live_prediction_join"](spark, sf).count()
    newest = max(glob.glob(f"{shared_dir(spark)}/pred-*"), key=os.path.getmtime)
    stored, events = spark.read.parquet(f"{newest}/out").count(), spark.read.parquet(f"{sf}/events.parquet").count()
    assert stored == events and rows >= events


def test_repeats_over_batches(spark, tmp_path):
    rng, folder = np.random.default_rng(8), str(tmp_path / "in")
    times = {k: np.sort(rng.uniform(0, 200, 150)) for k in ("x", "y")}
    for a in (0, 70, 140):
        schema = feed(spark, folder, [(k, at(h)) for k, v in times.items() for h in v if a <= h < a + 70], ["alert_id", "ts"])
        out = L.run_to_files(L.suppress_repeats(spark.readStream.schema(schema).parquet(folder)), str(tmp_path / "out"))
    want, stamp = [], lambda h: at(h).floor("us")
    for k, v in times.items():
        last = None
        for h in v:
            if last is None or h - last >= 4:
                want.append((k, stamp(h)))
                last = h
    got = [(r.alert_id, pd.Timestamp(r.ts)) for r in out.collect()]
    assert len(got) == len(want) and all(a == b and abs(x - y) < pd.Timedelta(milliseconds=1) for (a, x), (b, y) in zip(sorted(got), sorted(want)))


def test_carried_mean():
    x, y, out = np.random.default_rng(3).normal(size=700), 2.0, []
    for v in x:
        y += 0.1 * (v - y)
        out.append(y)
    assert L.carried_mean(x, 2.0, 0.1) == pytest.approx(np.array(out))


def test_predictions_meet_bars_by_stretches_of_the_clock(spark, tmp_path):
    """An interval that lies in two stretches finds the bars of both, once each; the join is not by ticker alone."""
    p_in, b_in = str(tmp_path / "p"), str(tmp_path / "b")
    ps = feed(spark, p_in, [("A", at(0.1), 100.0, 1)], ["ticker", "ts", "price", "id"])
    bs = feed(spark, b_in, [("A", at(h), v) for h, v in ((1.09, 1.0), (1.1, 101.0), (1.24, 102.0), (1.26, 103.0), (1.34, 104.0), (1.35, 1.0), (9.0, 1.0))], ["ticker", "ts", "close"])
    read = lambda s, f: spark.readStream.schema(s).parquet(f)
    j = L.evaluate_predictions(read(ps, p_in), read(bs, b_in), keep=("id",))
    assert "slot" in j._jdf.queryExecution().analyzed().toString()
    out = L.run_to_files(j, str(tmp_path / "out"))
    assert sorted(round(r.actual_pct, 6) for r in out.collect()) == [1.0, 2.0, 3.0, 4.0]
