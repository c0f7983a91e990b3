"""Scores, sums and selections that lie on a threshold."""
from pyspark.sql import functions as F

from barflow.operators import scanners as C

c = F.col


def test_score_on_the_threshold_is_a_signal(spark):
    """2.5 * 3 + 0.8 * 1.5 - 2.2 is 6.5, though not when added up as doubles."""
    row = dict(rsi=50.0, rsi_mom=0.0, stoch_k=50.0, stoch_d=50.0, bb_pos=1.1, ema_fast=2.0, ema_slow=1.0, p_ema_fast=1.0, p_ema_slow=1.0, bb_width=0.1,
               macd_hist=0.1, p_hist=0.1, macd_mom=-0.01, volume_ratio=1.0, roc=0.0, roc10=0.0, higher_highs=3.0, higher_lows=2.0, vol_ratio=1.0)
    df = spark.createDataFrame([row]).select(C.momentum_score().alias("raw"), C.exact(C.momentum_score()).alias("score"))
    got = df.withColumn("signal", C.side(c("score"), C.THRESHOLD["momentum"])).first()
    assert got.raw < 6.5 and got.score == 6.5 and got.signal == 1


def test_tie_of_the_sides_is_a_hold(spark):
    """0.63 + 0.49 + 0.56 is 1.5 times 0.56 + 0.56, whatever the order in which doubles are added."""
    rows = [("bullish", 0.9, 0.7), ("bullish", 0.7, 0.7), ("bullish", 0.8, 0.7), ("bearish", 0.8, 0.7), ("bearish", 0.8, 0.7)]
    df = spark.createDataFrame([("T", *x) for x in rows], "ticker string, direction string, strength double, volume_confirmation double")
    got = C.next_day_summary(df).first()
    assert (got.bull, got.bear, got.recommendation, got.confidence) == (1.68, 1.12, "HOLD", 0.5)


def test_next_day_ties_are_decided_by_plain_sums(spark):
    """Sides that tie at 1.5 times in decimals are decided by sums of doubles, as in the SQL, in any order of the rows."""
    sides = {"buy": ([(0.7, 0.9), (0.7, 0.9)], [(0.7, 0.5), (0.7, 0.7)]), "hold": ([(0.8, 0.7), (0.7, 0.9), (0.7, 0.7)], [(0.7, 0.7), (0.7, 0.9)])}
    rows = [(t, d, *x) for t, (bull, bear) in sides.items() for d, side in (("bullish", bull), ("bearish", bear)) for x in side]
    for some in (rows, rows[::-1]):
        got = C.next_day_summary(spark.createDataFrame(some, "ticker string, direction string, strength double, volume_confirmation double")).collect()
        assert {x.ticker: (x.recommendation, x.bull, x.bear, x.patterns, x.neutral) for x in got} == {"buy": ("BUY", 1.26, 0.84, 4, 0), "hold": ("HOLD", 1.68, 1.12, 5, 0)}


def test_morning_selection_takes_thirty_days(spark):
    """Tickers without a scan on the newest two days keep their selection."""
    import __spark_entry__ as entry
    assert "INTERVAL '30 days'" in entry.oracle_sql()["scan_morning_selection"]
    df = entry.queries()["scan_morning_selection"](spark, "/root/testdata/sf0.001")
    newest = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").agg(F.max("l_shipdate")).first()[0]
    days = [(newest - x.ts).days for x in df.select("ts").collect()]
    assert max(days) > 1 and max(days) <= 30
