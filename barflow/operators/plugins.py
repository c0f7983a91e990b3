"""A surface for the caller's own models and scanners.

A model is any function from bars (ticker, ts, open, high, low, close, volume) to rows (ticker, ts, signal) with signal -1, 0 or 1, a scanner one to patterns
(ticker, ts, pattern). The operators of this library that have that form are models as they are; ``python_model`` makes one of a function on
pandas frames, which runs over the bounded blocks of ``series``."""
from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from barflow.operators import charts as H, ensemble as E, indicators as I, joins as J, regimes as R, series as S

c = F.col
Model = Callable[[DataFrame], DataFrame]
BARS = {"open": T.NumericType, "high": T.NumericType, "low": T.NumericType, "close": T.NumericType, "volume": T.NumericType}


def require(df: DataFrame, what: str, columns: dict[str, type]) -> DataFrame:
    """``df``, if it has ticker, ts and ``columns`` of these types; else a ValueError that names what is missing."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    wanted = {"ticker": T.StringType, "ts": (T.TimestampType, T.TimestampNTZType, T.DateType), **columns}
    wrong = [f"{n} ({kinds[n].simpleString() if n in kinds else 'missing'})" for n, t in wanted.items() if not isinstance(kinds.get(n), t)]
    if wrong:
        raise ValueError(f"{what} lacks or mistypes: {', '.join(wrong)}")
    return df


def signals(model: Model, bars: DataFrame, what: str = "model") -> DataFrame:
    """(ticker, ts, signal) of a model over ``bars``, both checked; signals are cut to their sign, NULL is 0."""
    got = require(model(require(bars, "bars", BARS)), what, {"signal": T.NumericType})
    return got.select("ticker", "ts", F.coalesce(F.signum("signal"), F.lit(0)).cast("int").alias("signal"))


def python_model(function: Callable[[pd.DataFrame], pd.Series], lookback: int, interval_s: int = 900) -> Model:
    """A model from ``function``: bars of one ticker in time order (a pandas frame) -> one signal per bar, each from at most ``lookback`` bars before it.

    It runs block by block: a block holds a bounded number of bars and the ``lookback`` bars before them, whose own signals are thrown away. A
    function that gives another number of values raises."""
    if lookback > S.HALO_ROWS:
        raise ValueError(f"lookback may be {S.HALO_ROWS} bars at most")

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts", ignore_index=True)
        got = function(frame.drop(columns=[S.BLK, S.HALO, S.POS]))
        if len(got) != len(frame):
            raise ValueError(f"the model gave {len(got)} values for {len(frame)} bars")
        out = frame[["ticker", "ts"]].assign(signal=pd.Series(got).to_numpy(float))
        return out[~frame[S.HALO].to_numpy(bool)]

    def model(bars: DataFrame) -> DataFrame:
        rows = S.blocked(bars.select("ticker", "ts", *BARS), interval_s, halo=max(lookback, 1), ahead=0)
        ts = bars.schema["ts"].dataType.simpleString()
        return rows.groupBy("ticker", S.BLK).applyInPandas(block, f"ticker string, ts {ts}, signal double")

    return model


def profiled(bars: DataFrame, config: DataFrame, profile) -> DataFrame:
    """Bars with ``profile`` (a column) and all settings of ``config`` for it; a profile it does not have takes those of the first fixed one."""
    names = [x.split()[0] for x in E.PROFILE_COLUMNS.split(", ")]
    return J.with_config(bars.withColumn("profile", profile), config, "profile", dict(zip(names[1:], E.PROFILES[0][1:])))


def ensemble(bars: DataFrame, momentum: Model, technical: Model, config: DataFrame, profile, interval_s: int = 900) -> DataFrame:
    """Two models under one profile: probabilities, regime, arbitration, daily cap and stops for every bar that both models judge.

    The regime uses the profile's own ADX, Hurst and Keltner thresholds, its score is the trailing median of the profile's ``smoothing`` bars.
    ``config``: rows like ``ensemble.PROFILES``; ``profile``: the column expression that names a bar's profile."""
    a = signals(momentum, bars, "momentum model").withColumnRenamed("signal", "momentum_signal")
    b = signals(technical, bars, "technical model").withColumnRenamed("signal", "technical_signal")
    df = S.blocked(profiled(bars, config, profile), interval_s)
    df = R.add_regime(df, c("adx_min"), c("hurst_max"), c("keltner_min"))
    score = F.lit(None).cast("double")
    for n in sorted({p[5] for p in E.PROFILES}):
        score = F.when(c("smoothing") == n, R.smooth(c("regime_score"), n)).otherwise(score)
    df = df.withColumn("_smooth", score).withColumns({"atr": S.mean(c("tr"), 14), "volume_ratio": F.try_divide(c("volume"), F.avg("volume").over(S.w(25, 1)))})
    df = I.add_rolling_vwap(df).withColumn("vwap", c("vwap_roll"))
    df = S.unblock(df).withColumn("regime_score", F.coalesce("_smooth", "regime_score")).drop("_smooth")
    df = df.join(a, ["ticker", "ts"]).join(b, ["ticker", "ts"])
    return E.stop_levels(E.cap_daily(E.decide(df)))


def with_volume(scanner: Callable[[DataFrame], DataFrame], least: float = 0.4, confidence: float = 0.6, interval_s: int = 900) -> Callable[[DataFrame], dict[str, DataFrame]]:
    """A scanner whose patterns carry the volume score of the nearest bar and the confidence it leaves them: ``patterns`` all of them, ``filtered`` those with a
    score of at least ``least`` and a confidence of 40 or more, ``summary`` of these by ticker. Patterns may bring their own ``confidence`` from 0 to 1."""
    def run(bars: DataFrame) -> dict[str, DataFrame]:
        found = require(scanner(require(bars, "bars", BARS)), "scanner", {"pattern": T.StringType})
        scored = S.unblock(H.add_signal_strength(I.volume_bundle(bars))).select("ticker", "ts", "score_bullish")
        own = c("confidence") if "confidence" in found.columns else F.lit(confidence)
        rows = J.asof_join(found, scored, "ts", ["score_bullish"], "nearest", interval_s).withColumn("volume_score", c("hit.score_bullish")).drop("hit")
        rows = rows.withColumn("confidence", H.adjust_confidence(own, c("volume_score")) * 100)
        kept = rows.filter((c("volume_score") >= least - 1e-9) & (c("confidence") >= 40))
        grade = F.when(c("volume_score") > 0.6, "high").when(c("volume_score") < 0.4, "low").otherwise("medium")
        summary = kept.groupBy("ticker").agg(F.count(F.lit(1)).alias("patterns"), F.avg("volume_score").alias("avg_score"), F.avg("confidence").alias("avg_confidence"),
                                             *[F.count_if(grade == g).alias(g) for g in ("high", "medium", "low")])
        return {"patterns": rows, "filtered": kept, "summary": summary}

    return run
