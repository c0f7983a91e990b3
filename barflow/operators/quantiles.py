"""Exact quantiles of groups of any size.

``percentile`` keeps every distinct value of a group in one buffer, which a hot group does not survive.  Here a sketch
brackets the wanted ranks first; a second pass works on distinct values with their counts, which combine map-side, so ties are one
row: it counts what lies below the bracket and keeps the distinct values inside it. A bracket is as wide as its group's size asks for:
some 50 ranks, or 0.06 % of a group of millions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barflow.operators.salting import salted_join

c = F.col
_EPS = (3e-4, 5e-3, 5e-2, 1.0)      # half widths; the first that spans 2.5 ranks of the group is used
_ACCURACY = 10000


def exact_quantiles(df: DataFrame, keys: list[str], x: str, qs: dict[str, float]) -> DataFrame:
    """keys + one column per name in ``qs``, linear interpolation between neighbours (NULLs ignored)."""
    df = df.select(*keys, c(x).alias("_x")).filter(c("_x").isNotNull())
    names = list(qs)
    cut = [v for q in qs.values() for e in _EPS for v in (max(q - e, 0.0), min(q + e, 1.0))]
    b = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"),
                              F.percentile_approx("_x", F.array(*[F.lit(v) for v in cut]), F.lit(_ACCURACY)).alias("_cut"))
    width = F.lit(len(_EPS) - 1)
    for k in reversed(range(len(_EPS) - 1)):
        width = F.when(c("_n") * _EPS[k] >= 2.5, k).otherwise(width)
    b = b.select(*keys, "_n", *[F.element_at("_cut", 2 * len(_EPS) * i + 2 * width + side + 1).alias(f"_{tag}{i}")
                                for i in range(len(names)) for side, tag in enumerate(("lo", "hi"))])
    counted = df.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_k"))
    j = salted_join(counted, b, keys, ["_x"])
    g = j.groupBy(*keys).agg(F.first("_n").alias("_n"), *[a for i in range(len(names)) for a in (
        F.coalesce(F.sum(F.when(c("_x") < c(f"_lo{i}"), c("_k"))), F.lit(0)).alias(f"_below{i}"),
        F.sort_array(F.collect_list(F.when((c("_x") >= c(f"_lo{i}")) & (c("_x") <= c(f"_hi{i}")), F.struct("_x", "_k")))).alias(f"_in{i}"))])

    def ranked(i: int, rank: Column) -> Column:
        """The value at a 0-based rank of the group: the first inside the bracket whose running count passes it."""
        start = F.struct(c(f"_below{i}").alias("n"), F.lit(None).cast(df.schema["_x"].dataType).alias("v"))
        step = lambda acc, e: F.struct((acc["n"] + e["_k"]).alias("n"), F.coalesce(acc["v"], F.when(acc["n"] + e["_k"] > rank, e["_x"])).alias("v"))
        return F.aggregate(f"_in{i}", start, step)["v"]

    def value(i: int, q: float) -> Column:
        h = (c("_n") - 1) * F.lit(q)
        at = F.floor(h)
        lo, hi = ranked(i, at), ranked(i, F.least(at + 1, c("_n") - 1))
        return lo + (hi - lo) * (h - at)
    return g.select(*keys, *[value(i, q).alias(n) for i, (n, q) in enumerate(qs.items())])
