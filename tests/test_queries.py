"""Registered queries against their SQL at the smallest scale.  BARFLOW_ALL=1 runs every one, else a selection."""
import os

import pytest

import __spark_entry__ as entry
from barflow.plans.check import compare, duck

SF = "/root/testdata/sf0.001"
SOME = ["bars_upsampled", "session_levels", "macd", "adx", "percent_rank", "join_asof_nearest", "join_range_after", "store_merge_latest",
        "clean_quality_report", "candle_events", "alerts_history", "strategy_flexible", "scan_optimized", "model_reversion", "chart_head_and_shoulders",
        "chart_volume_attached", "knn_session_forecast", "regime_volatility_terciles", "ensemble_signals", "position_sizes", "eval_trade_outcomes",
        "eval_forecasts", "text_mentions", "text_trends", "live_tumbling_bars", "live_suppress_repeats"]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("BARFLOW_ALL") else SOME


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    ok, note = compare(entry.queries()[name](spark, SF), duck(SF), entry.oracle_sql()[name])
    assert ok, note


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["ticker", "ts", "close", "sma_50", "high_52w", "volume_spike", "gap_pct", "breakout"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
