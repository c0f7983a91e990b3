"""Column helpers: NULL wherever a NaN or an infinity would appear."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def div(a: Column, b) -> Column:
    """a / b, NULL on a zero denominator."""
    return F.try_divide(a, b if isinstance(b, Column) else F.lit(b))


def clamp(x: Column, lo: float, hi: float) -> Column:
    """x held in [lo, hi]; NULL stays NULL."""
    return F.when(x < lo, F.lit(float(lo))).when(x > hi, F.lit(float(hi))).otherwise(x)


def pct(a: Column, b: Column) -> Column:
    """Change from b to a in percent."""
    return div(a - b, b) * 100


def r(x: Column, digits: int = 4) -> Column:
    """Round for comparison: halves go up even if the last bits of a sum differ between engines."""
    scale = F.lit(float(10 ** digits))
    return F.floor(x * scale + 0.50001) / scale


def flag(cond: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def pick(*pairs, default=None) -> Column:
    """First value whose condition holds: pick((cond, value), ..., default=value)."""
    out = None
    for cond, value in pairs:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    if default is None:
        return out
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def hour_of_day(ts: Column) -> Column:
    """Clock time as fractional hours."""
    return F.hour(ts) + F.minute(ts) / F.lit(60.0)
