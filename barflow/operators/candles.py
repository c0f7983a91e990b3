"""Candle patterns as flag columns of a blocked series, and event rows made from flags."""
from __future__ import annotations


from pyspark.sql import Column, DataFrame, functions as F

from barflow.functions.scalar import flag, pick
from barflow.operators import series as S

c = F.col


def add_shape(df: DataFrame) -> DataFrame:
    """Signed body, its size and the shadows."""
    return df.withColumns({
        "body": c("close") - c("open"), "body_abs": F.abs(c("close") - c("open")),
        "upper": c("high") - F.greatest(c("open"), c("close")), "lower": F.least(c("open"), c("close")) - c("low")})


def add_reversal_flags(df: DataFrame) -> DataFrame:
    """inside_bar, hammer (2 x body below, half a body above) and strict engulfing (1 bullish, -1 bearish, 0)."""
    return df.withColumns(reversal_flags(*[S.lag(x) for x in ("open", "high", "low", "close")]))


def reversal_flags(po: Column, ph: Column, pl: Column, pc_: Column) -> dict[str, Column]:
    """The flags of ``add_reversal_flags`` from the prices of the bar before."""
    body = F.abs(c("close") - c("open"))
    lower = F.least(c("open"), c("close")) - c("low")
    upper = c("high") - F.greatest(c("open"), c("close"))
    bull = (c("close") > c("open")) & (pc_ < po) & (c("close") > po) & (c("open") < pc_)
    bear = (c("close") < c("open")) & (pc_ > po) & (c("close") < po) & (c("open") > pc_)
    return {
        "inside_bar": flag((c("high") <= ph) & (c("low") >= pl)),
        "hammer": flag((lower > 2 * body) & (upper < 0.5 * body)),
        "engulfing": pick((bull, 1), (bear, -1), default=0)}


def add_daily_candles(df: DataFrame) -> DataFrame:
    """Rule set of the daily scan: inclusive engulfing, 2x/0.3x hammer and shooting star, doji, three in a row."""
    df = add_shape(df)
    b1, b2 = S.lag("body"), S.lag("body", 2)
    o1, c1, c2 = S.lag("open"), S.lag("close"), S.lag("close", 2)
    tr = F.greatest(c("high") - c("low"), F.abs(c("high") - c1), F.abs(c("low") - c1))
    third = c(S.POS) >= 2
    return df.withColumns({
        "bull_engulf": flag((b1 < 0) & (c("body") > 0) & (c("open") <= c1) & (c("close") >= o1)),
        "bear_engulf": flag((b1 > 0) & (c("body") < 0) & (c("open") >= c1) & (c("close") <= o1)),
        "hammer_bar": flag((c("body_abs") > 0) & (c("lower") > 2 * c("body_abs")) & (c("upper") < 0.3 * c("body_abs"))),
        "shooting_star": flag((c("body_abs") > 0) & (c("upper") > 2 * c("body_abs")) & (c("lower") < 0.3 * c("body_abs"))),
        "doji": flag((c(S.POS) >= 1) & (c("body_abs") < 0.1 * tr)),
        "white_soldiers": flag(third & (c("body") > 0) & (b1 > 0) & (b2 > 0) & (c("close") > c1) & (c1 > c2)),
        "black_crows": flag(third & (c("body") < 0) & (b1 < 0) & (b2 < 0) & (c("close") < c1) & (c1 < c2))})


# Flag, name, direction rule, strength, holding days.
DAILY_CANDLES = [
    ("bull_engulf", "Bullish Engulfing", "bullish", 0.8, 3),
    ("bear_engulf", "Bearish Engulfing", "bearish", 0.8, 3),
    ("hammer_bar", "Hammer", "bullish", 0.7, 2),
    ("shooting_star", "Shooting Star", "bearish", 0.7, 2),
    ("doji", "Doji", "neutral", 0.5, 1),
    ("white_soldiers", "Three White Soldiers", "bullish", 0.9, 5),
    ("black_crows", "Three Black Crows", "bearish", 0.9, 5),
]


def events_from_flags(df: DataFrame, table, keep: list[str]) -> DataFrame:
    """One row per raised flag; the direction rule is fixed, 'reversal' (against the trend of 5 bars) or 'sign'."""
    def direction(col: str, rule: str) -> Column:
        if rule == "reversal":
            return pick((c("up5"), "bearish"), default="bullish")
        if rule == "sign":
            return pick((c(col) > 0, "bullish"), default="bearish")
        return F.lit(rule)
    rows = F.array(*[
        F.when(c(col) != 0, F.struct(F.lit(name).alias("pattern"), direction(col, rule).alias("direction"),
                                     F.lit(strength).alias("strength"), F.lit(days).alias("holding_days")))
        for col, name, rule, strength, days in table])
    return df.select(*keep, F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("_e")).select(*keep, "_e.*")


def add_prior_trend(df: DataFrame) -> DataFrame:
    """up5: close above the close five bars before (the first bars compare with the first close)."""
    first = F.first("close").over(S.w(6))
    return df.withColumn("up5", c("close") > first)


def market_bias(events: DataFrame) -> DataFrame:
    """Bullish above 60 % of the directional events, bearish below 40 %."""
    g = events.groupBy("ticker").agg(
        F.count_if(c("direction") == "bullish").alias("bullish"),
        F.count_if(c("direction") == "bearish").alias("bearish"),
        F.count_if(c("direction") == "neutral").alias("neutral"))
    share = F.try_divide(c("bullish") * 100.0, c("bullish") + c("bearish"))
    return g.withColumn("bullish_pct", share).withColumn(
        "bias", pick((share > 60, "BULLISH"), (share < 40, "BEARISH"), default="NEUTRAL"))


# ---------------------------------------------------------------- the wider library set

class _Bar:
    """Columns of the bar k rows back, with the averages used by the usual candle definitions: a body is long or
    short against the mean of the ten bodies before it, a doji against a tenth of the ten ranges before it,
    'near' and 'equal' against the mean of the five ranges before it."""

    def __init__(self, k: int):
        def at(x):
            return c(f"_{x}_{k}")
        self.o, self.h, self.l, self.c = at("open"), at("high"), at("low"), at("close")
        self.body, self.up, self.dn, self.rng = at("body"), at("upper"), at("lower"), at("rng")
        self.long, self.short = self.body > at("avg_body"), self.body < at("avg_body")
        self.doji = self.body <= 0.1 * at("rng10")
        self.near, self.equal, self.far = 0.2 * at("rng5"), 0.05 * at("rng5"), 0.6 * at("rng5")
        tiny, half_shadow = 0.1 * at("rng10"), at("shadow10") / 2
        self.no_up, self.no_dn = self.up < tiny, self.dn < tiny
        self.short_up, self.short_dn = self.up < half_shadow, self.dn < half_shadow
        self.long_up, self.long_dn = self.up > self.body, self.dn > self.body
        self.very_long_up, self.very_long_dn = self.up > 2 * self.body, self.dn > 2 * self.body
        self.white, self.black = self.c >= self.o, self.c < self.o
        self.top, self.bottom = F.greatest(self.o, self.c), F.least(self.o, self.c)


def add_candle_averages(df: DataFrame) -> DataFrame:
    df = add_shape(df)
    ten, five = S.w(10, 1), S.w(5, 1)
    return df.withColumns({"avg_body": F.avg("body_abs").over(ten), "rng10": F.avg(c("high") - c("low")).over(ten),
                           "shadow10": F.avg(c("upper") + c("lower")).over(ten), "rng5": F.avg(c("high") - c("low")).over(five)})


_PRICES, _AVERAGES = ("open", "high", "low", "close"), ("avg_body", "rng10", "shadow10", "rng5")


def add_earlier_bars(df: DataFrame, back: int = 4) -> DataFrame:
    """The values of the current bar and of ``back`` bars before it as columns that all flags share. A window function inside each flag would be evaluated
    once per mention, which were 743 for the library; here it is one per value and bar."""
    df = df.withColumns({**{f"_{x}_{k}": S.lag(x, k) if k else c(x) for k in range(back + 1) for x in _PRICES + _AVERAGES}, "_close_5": S.lag("close", 5)})
    shape = {}
    for k in range(back + 1):
        o, h, lo, x = (c(f"_{p}_{k}") for p in _PRICES)
        shape |= {f"_body_{k}": F.abs(x - o), f"_upper_{k}": h - F.greatest(o, x), f"_lower_{k}": F.least(o, x) - lo, f"_rng_{k}": h - lo}
    return df.withColumns(shape)


def _gap_up(a: _Bar, b: _Bar) -> Column:
    """Bodies: a lies wholly above b."""
    return a.bottom > b.top


def _gap_down(a: _Bar, b: _Bar) -> Column:
    return a.top < b.bottom


def _same(x: Column, y: Column, tol: Column) -> Column:
    return F.abs(x - y) <= tol


def single_bar_flags() -> dict[str, Column]:
    b = _Bar(0)
    p = _Bar(1)
    small = b.body < 0.3 * b.rng
    downtrend, uptrend = c("close") < c("_close_5"), c("close") > c("_close_5")
    sign = pick((b.white, 1), default=-1)

    def signed(cond):
        return F.when(cond, sign).otherwise(F.lit(0))
    hammer = b.short & b.long_dn & b.no_up
    inverted = b.short & b.long_up & b.no_dn
    return {
        "cdl_doji": flag(b.doji),
        "cdl_hammer": flag(hammer & (b.bottom <= p.l + p.near)),
        "cdl_inverted_hammer": flag(inverted & _gap_down(b, p)),
        "cdl_shooting_star": -flag(inverted & _gap_up(b, p)),
        "cdl_hanging_man": -flag(hammer & (b.bottom >= p.h - p.near)),
        "cdl_spinning_top": signed(b.short & b.long_up & b.long_dn),
        "cdl_marubozu": signed(b.long & b.no_up & b.no_dn),
        "cdl_closing_marubozu": signed(b.long & ((b.white & b.no_up) | (b.black & b.no_dn))),
        "cdl_dragonfly_doji": flag(b.doji & b.no_up & ~b.no_dn),
        "cdl_gravestone_doji": -flag(b.doji & b.no_dn & ~b.no_up),
        "cdl_long_legged_doji": flag(b.doji & (b.long_up | b.long_dn)),
        "cdl_rickshaw_man": flag(b.doji & b.long_up & b.long_dn & _same((b.top + b.bottom) / 2, (b.h + b.l) / 2, b.near)),
        "cdl_high_wave": signed(b.short & b.very_long_up & b.very_long_dn),
        "cdl_long_line": signed(b.long & b.short_up & b.short_dn),
        "cdl_short_line": signed(b.short & b.short_up & b.short_dn),
        "cdl_belt_hold": signed(b.long & ((b.white & b.no_dn) | (b.black & b.no_up))),
        "cdl_takuri": flag(b.doji & b.no_up & b.very_long_dn),
    }


def two_bar_flags() -> dict[str, Column]:
    a, b = _Bar(1), _Bar(0)
    marubozu_a, marubozu_b = a.long & a.no_up & a.no_dn, b.long & b.no_up & b.no_dn
    inside = (b.top < a.top) & (b.bottom > a.bottom)
    opposite = a.white != b.white

    def turn(cond, sign):
        return F.when(cond, sign).otherwise(F.lit(0))
    against = pick((a.black, 1), default=-1)
    now = pick((b.white, 1), default=-1)
    kick = opposite & marubozu_a & marubozu_b & F.when(a.black, _gap_up(b, a)).otherwise(_gap_down(b, a))
    return {
        "cdl_engulfing": pick((a.black & b.white & (b.c >= a.o) & (b.o <= a.c) & (b.body > a.body), 1),
                              (a.white & b.black & (b.c <= a.o) & (b.o >= a.c) & (b.body > a.body), -1), default=0),
        "cdl_harami": turn(a.long & b.short & inside, against),
        "cdl_harami_cross": turn(a.long & b.doji & inside, against),
        "cdl_piercing": flag(a.black & a.long & b.white & b.long & (b.o < a.l) & (b.c < a.o) & (b.c > (a.o + a.c) / 2)),
        "cdl_dark_cloud_cover": -flag(a.white & a.long & b.black & (b.o > a.h) & (b.c > a.o) & (b.c < (a.o + a.c) / 2)),
        "cdl_doji_star": turn(a.long & b.doji & F.when(a.white, _gap_up(b, a)).otherwise(_gap_down(b, a)), against),
        "cdl_counterattack": turn(opposite & a.long & b.long & _same(a.c, b.c, a.equal), now),
        "cdl_homing_pigeon": flag(a.black & b.black & a.long & b.short & inside),
        "cdl_in_neck": -flag(a.black & a.long & b.white & (b.o < a.l) & (b.c >= a.c) & (b.c <= a.c + a.equal)),
        "cdl_on_neck": -flag(a.black & a.long & b.white & (b.o < a.l) & _same(b.c, a.l, a.equal)),
        "cdl_thrusting": -flag(a.black & a.long & b.white & (b.o < a.l) & (b.c > a.c + a.equal) & (b.c <= (a.o + a.c) / 2)),
        "cdl_matching_low": flag(a.black & b.black & _same(a.c, b.c, a.equal)),
        "cdl_kicking": turn(kick, now),
        "cdl_kicking_by_length": turn(kick, F.when(b.body > a.body, now).otherwise(-now)),
        "cdl_separating_lines": turn(opposite & _same(a.o, b.o, a.equal) & b.long
                                     & F.when(b.white, b.no_dn).otherwise(b.no_up), now),
    }


def three_bar_flags() -> dict[str, Column]:
    a, b, d = _Bar(2), _Bar(1), _Bar(0)
    inside = (b.top < a.top) & (b.bottom > a.bottom)
    whites = a.white & b.white & d.white
    blacks = a.black & b.black & d.black
    deep_up = d.c > a.c + 0.3 * a.body
    deep_dn = d.c < a.c - 0.3 * a.body
    falling = (b.c < a.c) & (d.c < b.c)
    rising = (b.c > a.c) & (d.c > b.c)
    eng_bull = a.black & b.white & (b.c >= a.o) & (b.o <= a.c)
    eng_bear = a.white & b.black & (b.c <= a.o) & (b.o >= a.c)
    inside_range = (b.h < a.h) & (b.l > a.l)
    return {
        "cdl_morning_star": flag(a.black & a.long & b.short & _gap_down(b, a) & d.white & ~d.short & deep_up),
        "cdl_evening_star": -flag(a.white & a.long & b.short & _gap_up(b, a) & d.black & ~d.short & deep_dn),
        "cdl_morning_doji_star": flag(a.black & a.long & b.doji & _gap_down(b, a) & d.white & ~d.short & deep_up),
        "cdl_evening_doji_star": -flag(a.white & a.long & b.doji & _gap_up(b, a) & d.black & ~d.short & deep_dn),
        "cdl_three_inside": pick((a.long & b.short & inside & a.black & d.white & (d.c > a.o), 1),
                                 (a.long & b.short & inside & a.white & d.black & (d.c < a.o), -1), default=0),
        "cdl_three_outside": pick((eng_bull & (d.c > b.c), 1), (eng_bear & (d.c < b.c), -1), default=0),
        "cdl_three_white_soldiers": flag(whites & rising & a.no_up & b.no_up & d.no_up & (b.o > a.o) & (b.o <= a.c + a.near)
                                         & (d.o > b.o) & (d.o <= b.c + b.near) & ~d.short),
        "cdl_three_black_crows": -flag(blacks & falling & a.no_dn & b.no_dn & d.no_dn & (b.o < a.o) & (b.o > a.c)
                                       & (d.o < b.o) & (d.o > b.c)),
        "cdl_identical_three_crows": -flag(blacks & falling & a.no_dn & b.no_dn & d.no_dn & _same(b.o, a.c, a.equal)
                                           & _same(d.o, b.c, b.equal)),
        "cdl_two_crows": -flag(a.white & a.long & b.black & _gap_up(b, a) & d.black & (d.o < b.o) & (d.o > b.c)
                               & (d.c > a.o) & (d.c < a.c)),
        "cdl_upside_gap_two_crows": -flag(a.white & a.long & b.black & b.short & _gap_up(b, a) & d.black & (d.o > b.o)
                                          & (d.c < b.c) & (d.c > a.c)),
        "cdl_abandoned_baby": pick((a.black & a.long & b.doji & (b.h < a.l) & d.white & (d.l > b.h) & deep_up, 1),
                                   (a.white & a.long & b.doji & (b.l > a.h) & d.black & (d.h < b.l) & deep_dn, -1), default=0),
        "cdl_advance_block": -flag(whites & rising & (b.o > a.o) & (b.o <= a.c + a.near) & (d.o > b.o)
                                   & (d.o <= b.c + b.near) & a.long & (b.body < a.body) & (d.body < b.body) & d.long_up),
        "cdl_stalled": -flag(whites & rising & a.long & b.long & d.short & b.no_up & (d.o >= b.c - d.body - b.near)),
        "cdl_stick_sandwich": flag(a.black & b.white & d.black & (b.l > a.c) & _same(d.c, a.c, a.equal)),
        "cdl_tasuki_gap": pick((a.white & b.white & _gap_up(b, a) & d.black & (d.o < b.c) & (d.o > b.o) & (d.c < b.o)
                                & (d.c > a.top), 1),
                               (a.black & b.black & _gap_down(b, a) & d.white & (d.o > b.c) & (d.o < b.o) & (d.c > b.o)
                                & (d.c < a.bottom), -1), default=0),
        "cdl_side_by_side_white": pick((b.white & d.white & _gap_up(b, a) & _gap_up(d, a) & _same(d.body, b.body, b.near)
                                        & _same(d.o, b.o, b.equal), 1),
                                       (b.white & d.white & _gap_down(b, a) & _gap_down(d, a)
                                        & _same(d.body, b.body, b.near) & _same(d.o, b.o, b.equal), -1), default=0),
        "cdl_tristar": pick((a.doji & b.doji & d.doji & _gap_up(b, a) & (d.top < b.top), -1),
                            (a.doji & b.doji & d.doji & _gap_down(b, a) & (d.bottom > b.bottom), 1), default=0),
        "cdl_unique_three_river": flag(a.black & a.long & b.black & (b.c > a.c) & (b.o <= a.o) & (b.l < a.l) & d.white
                                       & d.short & (d.o > b.l)),
        "cdl_three_stars_in_south": flag(blacks & a.long & a.long_dn & (b.body < a.body) & (b.o > a.c) & (b.o <= a.h)
                                         & (b.l < a.c) & (b.l >= a.l) & ~b.no_dn & d.short & d.no_up & d.no_dn
                                         & (d.l > b.l) & (d.h < b.h)),
        "cdl_gap_three_methods": pick((a.white & b.white & d.black & _gap_up(b, a) & (d.o < b.c) & (d.o > b.o)
                                       & (d.c > a.o) & (d.c < a.c), 1),
                                      (a.black & b.black & d.white & _gap_down(b, a) & (d.o > b.c) & (d.o < b.o)
                                       & (d.c < a.o) & (d.c > a.c), -1), default=0),
        "cdl_hikkake": pick((inside_range & (d.h < b.h) & (d.l < b.l), 1), (inside_range & (d.h > b.h) & (d.l > b.l), -1),
                            default=0),
    }


def many_bar_flags() -> dict[str, Column]:
    z, a, b, d, e = _Bar(4), _Bar(3), _Bar(2), _Bar(1), _Bar(0)
    # A lambda keeps the projection of the flags out of whole-stage code: as one method it is too large for the JVM to compile, outside it is cut up.
    small3 = F.forall(F.array(a.short, b.short, d.short), lambda x: x)
    held_up = (F.least(a.bottom, b.bottom, d.bottom) > z.l) & (F.greatest(a.top, b.top, d.top) < z.h)
    strike_up = a.white & b.white & d.white & (b.c > a.c) & (d.c > b.c) & e.black & (e.o > d.c) & (e.c < a.o)
    strike_dn = a.black & b.black & d.black & (b.c < a.c) & (d.c < b.c) & e.white & (e.o < d.c) & (e.c > a.o)
    inner = (b.h < a.h) & (b.l > a.l) & (d.h < b.h) & (d.l > b.l)
    return {
        "cdl_three_line_strike": pick((strike_up, 1), (strike_dn, -1), default=0),
        "cdl_concealing_baby_swallow": flag(a.black & b.black & d.black & e.black & a.no_up & a.no_dn & b.no_up & b.no_dn
                                            & _gap_down(d, b) & d.long_up & (d.h > b.c) & (e.h > d.h) & (e.l < d.l)),
        "cdl_breakaway": pick((z.black & z.long & a.black & _gap_down(a, z) & (b.h < a.h) & (b.l < a.l) & d.black
                               & (d.h < b.h) & (d.l < b.l) & e.white & (e.c > a.o) & (e.c < z.c), 1),
                              (z.white & z.long & a.white & _gap_up(a, z) & (b.h > a.h) & (b.l > a.l) & d.white
                               & (d.h > b.h) & (d.l > b.l) & e.black & (e.c < a.o) & (e.c > z.c), -1), default=0),
        "cdl_ladder_bottom": flag(z.black & a.black & b.black & (a.o < z.o) & (b.o < a.o) & (a.c < z.c) & (b.c < a.c)
                                  & d.black & ~d.no_up & e.white & (e.o > d.o) & (e.c > d.h)),
        "cdl_mat_hold": flag(z.white & z.long & a.black & _gap_up(a, z) & small3 & (b.bottom < z.c) & (d.bottom < z.c)
                             & (d.bottom > z.o) & e.white & (e.o > d.c) & (e.c > F.greatest(a.h, b.h, d.h))),
        "cdl_rising_falling_three": pick((z.white & z.long & small3 & held_up & a.black & d.black & e.white & e.long
                                          & (e.c > z.c), 1),
                                         (z.black & z.long & small3 & held_up & a.white & d.white & e.black & e.long
                                          & (e.c < z.c), -1), default=0),
        "cdl_modified_hikkake": pick((inner & (b.c <= b.l + b.near) & (e.h < d.h) & (e.l < d.l), 1),
                                     (inner & (b.c >= b.h - b.near) & (e.h > d.h) & (e.l > d.l), -1), default=0),
    }


def candle_library(df: DataFrame) -> DataFrame:
    """All library flags (1, -1 or 0) on a blocked series, in one window pass."""
    names = df.columns
    df = add_earlier_bars(add_candle_averages(df))
    flags = {**single_bar_flags(), **two_bar_flags(), **three_bar_flags(), **many_bar_flags()}
    ready = c(S.POS) >= 14
    return df.select(*names, *[F.coalesce(F.when(ready, v), F.lit(0)).alias(k) for k, v in flags.items()])


def library_names() -> list[str]:
    return [*single_bar_flags(), *two_bar_flags(), *three_bar_flags(), *many_bar_flags()]


def library_events(df: DataFrame) -> DataFrame:
    """(ticker, ts, pattern, value) for every non-zero library flag."""
    names = library_names()
    rows = df.select("ticker", "ts", "close", "high", "low", F.posexplode(F.array(*[c(n) for n in names])).alias("_i", "value")).filter(c("value") != 0)
    return rows.select("ticker", "ts", F.element_at(F.array(*[F.lit(n) for n in names]), c("_i") + 1).alias("pattern"), "value", c("close").alias("price"), "high", "low")
