"""Two-model ensembles: probabilities, regime weights, arbitration, trade caps, levels, cards, sizes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barflow.functions.scalar import clamp, div, flag, pick
from barflow.operators import regimes as R
from barflow.operators.joins import with_config

c = F.col

# Settings of the four ticker profiles.
PROFILE_COLUMNS = ("profile string, version int, adx_min double, hurst_max double, keltner_min double, smoothing int, full double, half double, "
                   "quarter double, min_conf double, long_at double, short_at double, strength double, max_daily int, stop_mult double, trail_r double, min_size double")
PROFILES = [
    ("NVDA", 1, 30.0, 0.40, 0.25, 3, 1.0, 0.6, 0.3, 0.55, 0.55, 0.45, 0.0, 1000, 0.5, 0.5, 0.2),
    ("TSLA", 1, 28.0, 0.35, 0.30, 2, 0.9, 0.5, 0.25, 0.5, 0.5, 0.5, 0.0, 1000, 0.5, 0.5, 0.15),
    ("AAPL", 2, 25.0, 0.45, 0.15, 10, 0.8, 0.4, 0.2, 0.65, 0.6, 0.4, 2.0, 2, 0.5, 0.5, 0.0),
    ("MSFT", 2, 22.0, 0.50, 0.12, 15, 0.7, 0.35, 0.15, 0.7, 0.65, 0.35, 2.5, 1, 0.5, 0.5, 0.0),
]


def profiles(spark) -> DataFrame:
    return spark.createDataFrame(PROFILES, PROFILE_COLUMNS)


def probability(signal: Column, strength: Column) -> Column:
    """0.5 + 0.4 s for version 1, logistic(strength * s) for version 2."""
    return F.when(c("version") == 1, 0.5 + 0.4 * signal).otherwise(1 / (1 + F.exp(-strength * signal)))


def _take(signal: Column, size: Column | float) -> Column:
    return F.struct(signal.cast("int").alias("signal"), (size if isinstance(size, Column) else F.lit(size)).alias("size"))


def arbitrate() -> Column:
    """Signal and size from both models, the regime label and the blended probability (columns of ``combine``)."""
    m, t, reg, p = c("momentum_signal"), c("technical_signal"), c("regime_label"), c("ensemble_prob")
    e = pick((p >= c("long_at"), 1), (p <= c("short_at"), -1), default=0)
    conf = F.abs(p - 0.5) * 2
    none = _take(F.lit(0), 0.0)
    agree, clash = (m == t) & (m != 0), (m != 0) & (t != 0) & (m != t)
    only_m, only_t = (m != 0) & (t == 0), (t != 0) & (m == 0)
    trend, rng, unsure = reg == "trending", reg == "ranging", reg == "uncertain"
    v1 = pick((agree, _take(m, c("full"))),
              (clash & trend, _take(m, c("half"))), (clash & rng, _take(t, c("half"))), (clash, _take(e, c("quarter"))),
              (only_m & trend, _take(m, c("half"))), (only_m & unsure, _take(m, c("quarter"))),
              (only_t & rng, _take(t, c("half"))), (only_t & unsure, _take(t, c("quarter"))),
              ((m == 0) & (t == 0) & (F.abs(p - 0.5) > 0.2), _take(e, c("quarter"))), default=none)
    sure_m, sure_t, ok = F.abs(c("momentum_prob") - 0.5), F.abs(c("technical_prob") - 0.5), conf >= c("min_conf")
    v2 = pick((agree & (sure_m > 0.25) & (sure_t > 0.25), _take(m, c("full"))), (agree, _take(m, c("half"))),
              (clash & ok & trend, _take(m, c("quarter"))), (clash & ok & rng, _take(t, c("quarter"))),
              (only_m & trend & (sure_m > 0.3), _take(m, c("half"))), (only_m & unsure & ok, _take(m, c("quarter"))),
              (only_t & rng & (sure_t > 0.3), _take(t, c("half"))), (only_t & unsure & ok, _take(t, c("quarter"))),
              ((m == 0) & (t == 0) & (conf >= c("min_conf") * 1.2), _take(e, c("quarter"))), default=none)
    return F.when(c("version") == 1, v1).otherwise(v2)


def combine(df: DataFrame, config: DataFrame) -> DataFrame:
    """Needs profile, momentum_signal, technical_signal, regime_score, regime_label.  A profile it does not have takes the settings of the first fixed one."""
    names = [x.split()[0] for x in PROFILE_COLUMNS.split(", ")]
    return decide(with_config(df, config, "profile", dict(zip(names[1:], PROFILES[0][1:]))))


def decide(df: DataFrame) -> DataFrame:
    """``combine`` for rows that carry the settings of their profile already."""
    df = df.withColumns({"momentum_prob": probability(c("momentum_signal"), c("strength")),
                         "technical_prob": probability(c("technical_signal"), c("strength")),
                         "w_momentum": F.when(c("version") == 1, R.linear_weight(c("regime_score"))).otherwise(
                             R.profile_weight(c("profile"), c("regime_score")))})
    df = df.withColumn("ensemble_prob", c("w_momentum") * c("momentum_prob") + (1 - c("w_momentum")) * c("technical_prob"))
    return df.withColumn("_x", arbitrate()).withColumns({"signal": c("_x.signal"), "size": c("_x.size")}).drop("_x")


def cap_daily(df: DataFrame) -> DataFrame:
    """Only the first ``max_daily`` signalled bars of a (ticker, date); later bars are zeroed."""
    w = Window.partitionBy("ticker", F.to_date("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.sum(flag((c("signal") != 0) & (c("size") > 0))).over(w), F.lit(0))
    keep = taken < c("max_daily")
    return df.withColumns({"signal": F.when(keep, c("signal")).otherwise(0), "size": F.when(keep, c("size")).otherwise(0.0)})


def stop_levels(df: DataFrame) -> DataFrame:
    """Stop and trailing start from ATR (1 % of price where ATR is missing)."""
    atr = F.coalesce(c("atr"), c("close") * 0.01)
    on = (c("signal") != 0) & (c("size") > 0)
    return df.withColumns({"stop_price": F.when(on, c("close") - c("signal") * c("stop_mult") * atr).otherwise(0.0),
                           "trailing_stop": F.when(on, c("close") + c("signal") * c("trail_r") * atr).otherwise(0.0)})


def size_filters(df: DataFrame) -> DataFrame:
    """High volatility x 0.8, volume spike x 0.7, then the minimum size (needs vol_high, volume_spike flags)."""
    size = c("size") * pick(((c("profile") == "NVDA") & (c("vol_high") == 1), 0.8), ((c("profile") == "TSLA") & (c("volume_spike") == 1), 0.7), default=1.0)
    df = df.withColumn("size", size)
    small = c("size") < c("min_size")
    return df.withColumns({"signal": F.when(small, 0).otherwise(c("signal")), "size": F.when(small, 0.0).otherwise(c("size"))})


def attribution(df: DataFrame) -> DataFrame:
    """Agreement, regime shares, mean weights by regime, what drives signals, confidence; one pass per profile."""
    conf = F.abs(c("ensemble_prob") - 0.5) * 2
    taken = c("ensemble_prob") != 0.5
    return df.groupBy("profile").agg(
        F.avg(flag(c("momentum_signal") == c("technical_signal"))).alias("agreement"),
        *[F.avg(flag(c("regime_label") == x)).alias(f"share_{x}") for x in ("trending", "ranging", "uncertain")],
        *[F.avg(F.when(c("regime_label") == x, c("w_momentum"))).alias(f"w_{x}") for x in ("trending", "ranging", "uncertain")],
        F.avg(F.when(taken, flag(c("w_momentum") > 0.6))).alias("momentum_driven"),
        F.avg(F.when(taken, flag(1 - c("w_momentum") > 0.6))).alias("technical_driven"),
        F.avg(conf).alias("avg_confidence"), F.avg(flag(conf > c("min_conf"))).alias("high_confidence"))


def entry_bands(df: DataFrame) -> DataFrame:
    """Entry range between price and VWAP +-0.1 ATR, stop 0.5 ATR beyond, targets 0.5 / 1 / 1.5 ATR; NULL without a signal."""
    buy, sell, atr = c("signal") > 0, c("signal") < 0, c("atr")
    df = df.withColumns({"entry_low": F.when(buy | sell, F.least("close", "vwap") - 0.1 * atr),
                         "entry_high": F.when(buy | sell, F.greatest("close", "vwap") + 0.1 * atr)})
    lo, hi = c("entry_low"), c("entry_high")
    return df.withColumns({"stop_loss": pick((buy, lo - 0.5 * atr), (sell, hi + 0.5 * atr)),
                           **{f"target_{h}": pick((buy, hi + k * atr), (sell, lo - k * atr)) for h, k in (("1h", 0.5), ("3h", 1.0), ("eod", 1.5))}})


def percent_bands(df: DataFrame) -> DataFrame:
    """The variant without ATR: +-0.1 % entry, 2 % stop, 3 % target in thirds."""
    x, s = c("close"), F.signum("signal")
    on = c("signal") != 0
    return df.withColumns({"entry_low": F.when(on, x * 0.999), "entry_high": F.when(on, x * 1.001), "stop_loss": F.when(on, x - s * x * 0.02),
                           **{f"target_{h}": F.when(on, x + s * x * 0.03 * k) for h, k in (("1h", 0.33), ("3h", 0.66), ("eod", 1.0))}})


def signal_cards(df: DataFrame) -> DataFrame:
    """Nested card of each row with bands (needs volume_ratio, adx, keltner_pct and the ensemble columns)."""
    def rr(h):
        return div(F.abs(c(f"target_{h}") - c("entry_high")), F.abs(c("stop_loss") - c("entry_high")))
    agreement = pick((c("signal") == 0, "None"), (c("size") >= 1.0, "Strong Agreement"), (c("size") >= 0.5, "Moderate Agreement"),
                     (c("size") > 0, "Weak Agreement"), default="Conflict")
    return df.select(
        "ticker", "ts", pick((c("signal") > 0, "BUY"), (c("signal") < 0, "SELL"), default="NEUTRAL").alias("signal_type"),
        F.abs("signal").cast("double").alias("signal_strength"), c("size").alias("confidence"), c("close").alias("current_price"), "vwap", "volume_ratio",
        F.struct(c("regime_label").alias("label"), c("regime_score").alias("score"), "adx", "keltner_pct").alias("market_regime"),
        agreement.alias("model_agreement"), F.lit(3).alias("validity_bars"), (c("ts") + F.expr("INTERVAL 45 MINUTES")).alias("expires_at"),
        F.when(c("signal") != 0, F.struct("entry_low", "entry_high", "stop_loss", "target_1h", "target_3h", "target_eod", "atr")).alias("entry_bands"),
        F.when(c("signal") != 0, F.struct(rr("1h").alias("h1"), rr("3h").alias("h3"), rr("eod").alias("eod"))).alias("risk_reward"))


def actionable(cards: DataFrame, top: int = 3) -> tuple[DataFrame, DataFrame]:
    """(one row of counts, the top cards by confidence)."""
    active = cards.filter(c("signal_type") != "NEUTRAL")
    counts = active.agg(F.count(F.lit(1)).alias("total"), F.count_if(c("signal_type") == "BUY").alias("buys"),
                        F.count_if(c("signal_type") == "SELL").alias("sells"), F.count_if(c("confidence") >= 0.5).alias("high_confidence"))
    return counts, active.orderBy(c("confidence").desc(), "ts", "ticker").limit(top)


def active_table(cards: DataFrame, least: float = 0.7) -> DataFrame:
    """Confident active signals with their regime."""
    return cards.filter((c("signal_type") != "NEUTRAL") & (c("confidence") >= least)).select(
        "ticker", "ts", "signal_type", "confidence", c("market_regime.label").alias("regime"), c("entry_bands.stop_loss").alias("stop_loss"))


# ---------------------------------------------------------------- sizes

def position_sizes(df: DataFrame, account: float = 100000.0, risk: float = 0.02, max_pct: float = 0.25, kelly_fraction: float = 0.25,
                   win_rate: float = 0.5, avg_win: float = 1.5, avg_loss: float = 1.0) -> DataFrame:
    """Shares by fixed risk, fractional Kelly and volatility, and the recommended one by confidence band.

    Needs signal, confidence, entry_low, entry_high, stop_loss, atr; rows without a signal get no shares."""
    on = c("signal") != 0
    entry = (c("entry_low") + c("entry_high")) / 2
    df = df.withColumns({"entry_price": entry, "risk_per_share": F.abs(entry - c("stop_loss"))})
    e, rps, conf = c("entry_price"), c("risk_per_share"), c("confidence")

    def whole(x):
        return F.floor(x).cast("long")
    raw = whole(whole(div(F.lit(account * risk), rps)) * conf)
    fixed = F.when(raw * e > account * max_pct, whole(div(F.lit(account * max_pct), e))).otherwise(raw)
    p, b = win_rate * conf, avg_win / avg_loss
    kelly_pct = clamp((p * b - (1 - p)) / b * kelly_fraction, 0.0, max_pct)
    vol_pct = clamp(max_pct * (1 - div(c("atr"), e) * 10), 0.05, max_pct) * conf
    df = df.withColumns({"fixed_shares": F.when(on, fixed), "kelly_shares": F.when(on, whole(div(account * kelly_pct, e))),
                         "volatility_shares": F.when(on, whole(div(account * vol_pct, e)))})
    f, k, v = c("fixed_shares"), c("kelly_shares"), c("volatility_shares")
    low = F.least(f, k, v)
    rec = pick(((conf >= 0.7) & (k > f), F.struct(k.alias("shares"), F.lit("kelly_criterion").alias("method"))),
               (conf >= 0.7, F.struct(f.alias("shares"), F.lit("fixed_risk").alias("method"))),
               ((conf >= 0.5) & (low == f), F.struct(f.alias("shares"), F.lit("fixed_risk").alias("method"))),
               ((conf >= 0.5) & (low == k), F.struct(k.alias("shares"), F.lit("kelly_criterion").alias("method"))),
               default=F.struct(v.alias("shares"), F.lit("volatility_adjusted").alias("method")))
    df = df.withColumn("_r", F.when(on, rec))
    return df.withColumns({"shares": c("_r.shares"), "method": c("_r.method"), "position_value": c("_r.shares") * e,
                           "risk_amount": c("_r.shares") * rps}).drop("_r")


def portfolio(sized: DataFrame, account: float = 100000.0) -> DataFrame:
    return sized.groupBy("ticker").agg(F.count("shares").alias("positions"), F.sum("position_value").alias("allocated"), F.sum("risk_amount").alias("risk"),
                                       (F.sum("position_value") / account * 100).alias("allocated_pct"), (F.sum("risk_amount") / account * 100).alias("risk_pct"))
