"""Market regimes: composite score, smoothing, weights, volatility terciles, features and clusters."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barflow.functions.scalar import clamp, div, pick
from barflow.operators import indicators as I, series as S
from barflow.operators.quantiles import exact_quantiles
from barflow.operators.salting import salted_join
from barflow.session import cut_lineage

c = F.col


def add_regime(df: DataFrame, adx_min: float | Column = 25, hurst_max: float | Column = 0.45, keltner_min: float | Column = 0.2) -> DataFrame:
    """Score in (-1, 1) from z-scored ADX, Hurst and Keltner flags; label by +-0.3.  Blocked frame; thresholds may be columns, such as settings per ticker."""
    df = I.add_hurst(I.add_keltner(I.add_adx(I.add_change(df))))
    df = df.withColumns({"_a": F.when(c("adx") > adx_min, 1.0).otherwise(0.0), "_h": F.when(c("hurst") < hurst_max, 0.0).otherwise(1.0),
                         "_k": F.when(c("keltner_pct") > keltner_min, 1.0).otherwise(0.0)})
    z = 0.4 * I.zscore(c("_a")) + 0.4 * I.zscore(c("_h")) + 0.2 * I.zscore(c("_k"))
    df = df.withColumn("regime_score", F.tanh(z / 3)).drop("_a", "_h", "_k")
    return df.withColumns({"regime_label": label(c("regime_score")), "adx_rising": c("adx") > S.lag("adx", 5)})


def label(score: Column) -> Column:
    return pick((score > 0.3, "trending"), (score < -0.3, "ranging"), default="uncertain")


def smooth(x: Column, n: int = 3, centered: bool = False) -> Column:
    """Rolling median; trailing unless centered (which looks ahead)."""
    w = S._w().rowsBetween(-(n // 2), (n - 1) // 2) if centered else S.w(n)
    return F.percentile(x, F.lit(0.5)).over(w)


def linear_weight(score: Column) -> Column:
    """Momentum weight 0.5 + 0.5 * score in [0, 1]; the technical weight is the rest."""
    return clamp(0.5 + 0.5 * score, 0.0, 1.0)


def profile_weight(profile: Column, s: Column) -> Column:
    """Momentum weight by ticker profile."""
    up = F.greatest(s, F.lit(0.0))
    return pick((profile == "NVDA", 0.5 + 0.45 * up), (profile == "AAPL", 0.3 * up),
                (profile == "MSFT", F.when(s > 0.5, 0.4 + 0.3 * (s - 0.5)).otherwise(0.1)),
                (profile == "TSLA", F.when(s > 0.3, 0.6 + 0.35 * (s - 0.3) / 0.7).when(s < -0.3, 0.1).otherwise(0.3)),
                default=0.5 + 0.4 * up)


def volatility_terciles(bars: DataFrame, window: int = 780, interval_s: int = 900) -> DataFrame:
    """Annualised volatility, exact 33 % and 67 % cuts of the ticker, and the tercile 0/1/2 of each bar."""
    df = S.sliding(I.add_change(S.blocked(bars, interval_s)), {"_sd": (c("ret"), window, 0, "std")})
    df = df.withColumn("vol", F.when(c(S.POS) >= window, I.realised_vol(c("_sd"))))      # the first bar has no return
    df = cut_lineage(S.unblock(df).filter(c("vol").isNotNull()).select("ticker", "ts", "close", "vol"))   # read three times below
    cuts = exact_quantiles(df, ["ticker"], "vol", {"low_cut": 0.33, "high_cut": 0.67})
    return salted_join(df, cuts, ["ticker"], ["ts"]).withColumn("regime", pick((c("vol") <= c("low_cut"), 0), (c("vol") <= c("high_cut"), 1), default=2))


def regime_features(bars: DataFrame, days: int = 30, per_day: int = 26, interval_s: int = 900) -> DataFrame:
    """Volatility, trend, volume against 90 days, mean day range, and proximity to earnings months and option expiry,
    all from the ``days`` * ``per_day`` bars before the current one."""
    n = days * per_day
    df = I.add_change(S.blocked(bars, interval_s))
    df = df.withColumns({"_rng": div(F.max("high").over(S.w(per_day)) - F.min("low").over(S.w(per_day)), c("close")),
                         "_first": S.lag("close", n)})
    df = S.sliding(df, {"_vol": (c("ret"), n - 1, 1, "std"), "_v": (c("volume"), n, 1, "mean"), "_v90": (c("volume"), 90 * per_day, 1, "mean")})
    ranges = F.lit(0.0)
    for k in range(days):
        ranges = ranges + F.coalesce(S.lag("_rng", 1 + per_day * k), F.lit(0.0))
    month = F.month("ts")
    gap = F.least(*[F.abs(month - m) for m in (2, 5, 8, 11)]) * 30
    friday = F.next_day(F.make_date(F.year("ts"), month, F.lit(14)), "FRI").cast("timestamp")
    off = F.abs(F.floor((F.unix_micros(c("ts").cast("timestamp")) - F.unix_micros(friday)) / F.lit(86400000000)))
    df = df.withColumns({
        "realised_vol": I.realised_vol(c("_vol"), per_day), "trend_strength": F.abs(div(S.lag("close"), c("_first")) - 1),
        "volume_regime": F.when(c(S.POS) >= 90 * per_day, div(c("_v"), c("_v90"))).otherwise(1.0), "day_range": ranges / days,
        "earnings_proximity": F.exp(-gap / F.lit(45.0)), "expiry_proximity": F.exp(-off / F.lit(7.0))})
    return S.unblock(df.filter(c(S.POS) >= n)).drop("_rng", "_first", "_vol", "_v", "_v90")


FEATURES = ["realised_vol", "trend_strength", "volume_regime", "day_range", "earnings_proximity", "expiry_proximity"]


def cluster(features: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Standardise and k-means over all rows.  MLlib passes over the rows many times, so they are written once first."""
    features = cut_lineage(features)
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    model = Pipeline(stages=[
        VectorAssembler(inputCols=FEATURES, outputCol="_f"), StandardScaler(inputCol="_f", outputCol="_s", withMean=True),
        KMeans(k=k, seed=seed, featuresCol="_s", predictionCol="regime")]).fit(features)
    return model.transform(features).drop("_f", "_s")


def cluster_summary(clustered: DataFrame) -> DataFrame:
    g = clustered.groupBy("regime").agg(F.count(F.lit(1)).alias("count"), *[F.avg(x).alias(f"avg_{x}") for x in FEATURES])
    vol = pick((c("avg_realised_vol") > 0.4, "High vol"), (c("avg_realised_vol") > 0.2, "Medium vol"), default="Low vol")
    trend = pick((c("avg_trend_strength") > 0.1, "trending"), default="sideways")
    return g.withColumn("description", F.concat_ws(", ", vol, trend))
