"""Per-ticker series split into bounded blocks.

A window over ``partitionBy(ticker)`` puts one ticker on one task, so a ticker that holds a third of the
table would stall the job.  ``blocked`` cuts every series into blocks of about ``block_rows`` bars and copies
the last ``halo`` bars of a block to the next one and the first ``ahead`` bars back to the one before (outcomes look forward).  Windows then run over ``(ticker, _blk)``: one shuffle, each
group bounded, and every look-back up to ``halo`` bars is exact.  A ticker shorter than a block is one block.

How the cut is planned: bars are unique per (ticker, ts) and spaced by at least ``interval_s``, so a clock bucket
of ``bucket_rows`` intervals holds at most ``bucket_rows`` bars of a ticker.  The bars per (ticker, bucket) are
counted (map-side combined), summed up along the buckets of each ticker (a small table) and joined back.

A table that is small as a whole (by the optimizer's size estimate, checked at plan time like a broadcast) cannot
hold a long series: it skips the counting and is one block per ticker. So does a table whose clock is known to be short (``spanned``): bars
``interval_s`` apart fit a block if the whole table's first and last time are no more than ``block_rows`` intervals apart. Cutting costs a second
shuffle of the bars and whatever is carried over blocks reads them again.

Either way ``halo`` and ``ahead`` bind: ``unblock`` raises when a window over the blocks reaches further, and so does a recurrence
that needs more than ``halo`` bars to forget its start. A look-back too long for the cut is an error, never a different number.

Columns added: ``_blk``, ``_halo`` (row is a copy), ``_pos`` (0-based position in the whole series).
"""
from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

BLK, HALO, POS = "_blk", "_halo", "_pos"
DAY = 86400

BLOCK_ROWS = 131072
HALO_ROWS = 8192
AHEAD_ROWS = 1024
BUCKET_ROWS = 256
SMALL_BYTES = 32 << 20
TASK_BYTES = 1 << 20     # of the optimizer's estimate; daily bars are about 10 bytes of it, so about 100,000 bars
_ONE = "one_block"
_SPAN = "span_s"


def plan_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate, from file sizes and row widths; no job is run."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    except AttributeError:   # a remote session does not expose it
        return None


def task_count(df: DataFrame, task_bytes: int | None = None) -> int | None:
    """Tasks that hold about ``task_bytes`` of ``df`` each; None where the size is unknown. The estimate of a join is a product, so that of the tables read bounds it."""
    size = plan_bytes(df)
    if size is None:
        return None
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = min(size, sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())))
    return None if size > 1 << 42 else -(-size // (task_bytes or TASK_BYTES))


def spread(df: DataFrame, source: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt over tasks by ``keys``, as many as the size of ``source`` asks for. Each sort, of which a chain of windows has several, holds the rows of
    its task; adaptive execution would join partitions until there are as few tasks as cores, and a task would grow with the table."""
    n = task_count(source)
    return df if n is None or n <= 8 else df.repartition(n, *keys)


def spanned(bars: DataFrame, times: DataFrame, at: str = "ts") -> DataFrame:
    """``bars`` that know how long their clock is: the seconds from the first to the last time (column ``at``) of ``times``, from which they are made, one pass over one column.
    Only a table that would be cut is asked."""
    size = plan_bytes(bars)
    if size is not None and size <= SMALL_BYTES:
        return bars
    second = F.unix_seconds(F.col(at).cast("timestamp"))
    first, last = times.agg(F.min(second), F.max(second)).first()
    return bars if first is None else bars.withMetadata("ts", {_SPAN: last - first})


def short_clock(bars: DataFrame, interval_s: int, block_rows: int = BLOCK_ROWS) -> bool:
    """Whether the bars of any ticker are known to fit a block."""
    return bars.schema["ts"].metadata.get(_SPAN, math.inf) <= interval_s * block_rows


def one_block(df: DataFrame) -> bool:
    return bool(df.schema[BLK].metadata.get(_ONE))


def blocked(bars: DataFrame, interval_s: int = DAY, halo: int = HALO_ROWS, block_rows: int = BLOCK_ROWS,
            bucket_rows: int = BUCKET_ROWS, carry: Mapping[str, Column] | None = None,
            small_bytes: int = SMALL_BYTES, ahead: int = AHEAD_ROWS) -> DataFrame:
    """Cut ``bars`` into blocks.  ``carry`` names row-local amounts whose total over all rows before the first row
    of the block is wanted (column of that name, constant in a block)."""
    if max(halo, ahead) + 2 * bucket_rows > block_rows:
        raise ValueError("block_rows must exceed halo and ahead by 2 * bucket_rows")
    carry = carry or {}
    size = plan_bytes(bars) if small_bytes else None
    if size is not None and size <= small_bytes or short_clock(bars, interval_s, block_rows):
        df = spread(bars, bars, "ticker").withColumns({BLK: F.lit(0), HALO: F.lit(False), **{name: F.lit(0.0) for name in carry}})
        return df.withMetadata(BLK, {_ONE: True, "halo": halo, "ahead": ahead}).withColumn(POS, F.row_number().over(_w()).cast("long") - 1)
    bucket = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / F.lit(interval_s * bucket_rows))
    src = bars.withColumn("_tb", bucket)

    counts = src.groupBy("ticker", "_tb").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(name) for name, c in carry.items()])
    along = Window.partitionBy("ticker").orderBy("_tb")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    plan = counts.select(
        "ticker", "_tb", "_n",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_cum"),
        F.sum("_n").over(Window.partitionBy("ticker")).alias("_total"),
        *[F.coalesce(F.sum(name).over(before), F.lit(0.0)).alias(name) for name in carry])
    plan = plan.withColumn("_b", F.floor(F.col("_cum") / F.lit(block_rows)))
    end = F.max(F.col("_cum") + F.col("_n")).over(Window.partitionBy("ticker", "_b"))
    reaches_next = (end - (F.col("_cum") + F.col("_n")) < F.lit(halo)) & (end < F.col("_total"))
    start = F.min("_cum").over(Window.partitionBy("ticker", "_b"))
    near_start = (F.col("_cum") - start < F.lit(ahead)) & (F.col("_b") > 0)

    def home(shift: int, copied: bool):
        return F.struct((F.col("_b") + shift).alias("b"), F.lit(copied).alias("h"))
    homes = F.filter(F.array(home(0, False), F.when(reaches_next, home(1, True)), F.when(near_start, home(-1, True))),
                     lambda x: x.isNotNull())
    plan = plan.select("ticker", "_tb", "_cum", homes.alias("_homes"), *carry)

    rows = (
        src.join(plan, ["ticker", "_tb"])
        .withColumn("_home", F.explode("_homes"))
        .withColumn(BLK, F.col("_home.b")).withColumn(HALO, F.col("_home.h"))
        .drop("_tb", "_homes", "_home")
    )
    rows = spread(rows, bars, "ticker", BLK)
    out = rows.withColumn(POS, F.first("_cum").over(running()) + F.row_number().over(_w()) - 1)
    for name in carry:
        out = out.withColumn(name, F.first(name).over(running()))
    return out.drop("_cum").withMetadata(BLK, {"halo": halo, "ahead": ahead})


_FRAME = re.compile(r"windowspecdefinition\((?:[^()]|\([^()]*\))*?specifiedwindowframe\(RowFrame, ([^,]+), ([^()]+)(?:\(\))?\)")


def check_reach(df: DataFrame) -> None:
    """Raise if a row window over the blocks of ``df`` looks further back than their halo, or further on than ``ahead``. Frames without
    an end (running sums inside a block) are the operators' own business."""
    known = df.schema[BLK].metadata
    try:
        mark = f"{BLK}#{df.select(BLK)._jdf.queryExecution().analyzed().output().apply(0).exprId().id()}"
        plan = df._jdf.queryExecution().analyzed().treeString(True, False, 2**31 - 1, False, False)
    except AttributeError:   # a remote session does not expose its plan
        return
    for m in _FRAME.finditer(plan):
        if "halo" not in known or not re.search(mark + r"L?\b", m[0]) or "_chunk#" in m[0]:
            continue
        for edge in m.groups():
            if re.fullmatch(r"-?\d+", edge) and not -known["halo"] <= int(edge) <= known["ahead"]:
                raise ValueError(f"a window reaches {edge} rows, but blocks carry {known['halo']} rows before and {known['ahead']} after them")


def unblock(df: DataFrame) -> DataFrame:
    """Drop the copies and the helper columns."""
    check_reach(df)
    return df.filter(~F.col(HALO)).drop(BLK, HALO, POS)


def _w() -> WindowSpec:
    return Window.partitionBy("ticker", BLK).orderBy("ts")


def w(n: int, skip: int = 0) -> WindowSpec:
    """The last n rows, ending ``skip`` rows before the current one."""
    return _w().rowsBetween(-(n - 1) - skip, -skip)


def ahead(first: int, last: int) -> WindowSpec:
    """Rows first..last after the current one; only outcome operators look ahead."""
    return _w().rowsBetween(first, last)


def clock_ahead(seconds: int, interval_s: int) -> WindowSpec:
    """Rows later than the current one by at most ``seconds`` (the current time excluded). ``interval_s``: least distance of two bars, which bounds the rows."""
    if seconds > interval_s * AHEAD_ROWS:
        raise ValueError(f"{seconds} s ahead may be more than the {AHEAD_ROWS} rows that blocks carry after them")
    return Window.partitionBy("ticker", BLK).orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(1, seconds * 1_000_000)


def running() -> WindowSpec:
    """From the first row of the block (copies included) to the current row."""
    return _w().rowsBetween(Window.unboundedPreceding, 0)


def lag(c, k: int = 1) -> Column:
    return F.lag(c, k).over(_w())


def lead(c, k: int = 1) -> Column:
    return F.lead(c, k).over(_w())


def full(agg: Column, x: Column, n: int, skip: int = 0) -> Column:
    """``agg`` over the last n rows, NULL until n values of x are present."""
    return F.when(F.count(x).over(w(n, skip)) == n, agg.over(w(n, skip)))


def mean(x: Column, n: int, skip: int = 0) -> Column:
    return full(F.avg(x), x, n, skip)


def std(x: Column, n: int, ddof: int = 1) -> Column:
    return full(F.stddev_samp(x) if ddof else F.stddev_pop(x), x, n)


def sliding(df: DataFrame, specs: Mapping[str, tuple[Column, int, int, str]]) -> DataFrame:
    """Means (``mean``) and sample deviations (``std``) of long windows: name -> (x, n, skip, kind), over the values of x in the last n rows that end ``skip`` rows
    before the current one, NULL until there is one (two for a deviation). A window costs the same whatever its length: sums that run along the block,
    taken from each other n rows apart. Values are first taken from the block's own mean, so that large levels do not swallow small changes."""
    reach = max(n + skip for _, n, skip, _ in specs.values())
    halo = df.schema[BLK].metadata.get("halo")
    if halo is not None and reach > halo:
        raise ValueError(f"a window reaches {reach} rows, but blocks carry {halo} rows before them")
    whole, own = Window.partitionBy("ticker", BLK), {f"_v{i}": (name, *spec) for i, (name, spec) in enumerate(specs.items())}
    df = df.withColumns({v: x - F.avg(x).over(whole) for v, (_, x, _, _, _) in own.items()})
    sums = {}
    for v in own:
        present = F.col(v).isNotNull().cast("long")
        sums |= {f"{v}n": F.sum(present).over(running()), f"{v}s": F.coalesce(F.sum(v).over(running()), F.lit(0.0)),
                 f"{v}q": F.coalesce(F.sum(F.col(v) * F.col(v)).over(running()), F.lit(0.0)), f"{v}m": F.avg(own[v][1]).over(whole)}
    df = df.withColumns(sums)
    out = {}
    for v, (name, _, n, skip, kind) in own.items():
        def part(k: str) -> Column:
            end = lag(f"{v}{k}", skip) if skip else F.col(f"{v}{k}")
            return F.coalesce(end, F.lit(0)) - F.coalesce(lag(f"{v}{k}", n + skip), F.lit(0))
        count, total, squares = part("n"), part("s"), part("q")
        if kind == "mean":
            out[name] = F.when(count > 0, F.col(f"{v}m") + total / count)
        else:
            out[name] = F.when(count > 1, F.sqrt(F.greatest(squares - total * total / count, F.lit(0.0)) / (count - 1)))
    return df.withColumns(out).drop(*own, *sums)


# ---------------------------------------------------------------- linear recurrences

_FORGET = 37.0     # e^-37: what an older value still weighs is below double precision
_SAFE = 300.0      # e^(2*300) would overflow; e^300 leaves room for any price


def chunk_rows(alpha: float) -> int:
    """Rows after which an exponential filter has forgotten its start (power of two)."""
    lam = -math.log(1.0 - alpha)
    return 1 << max(4, math.ceil(math.log2(_FORGET / lam)))


def span(n: float) -> float:
    return 2.0 / (n + 1.0)


def wilder(n: float) -> float:
    return 1.0 / n


def ewm(df: DataFrame, specs: Mapping[str, tuple[Column, float, bool]]) -> DataFrame:
    """Exponentially weighted means ``name -> (x, alpha, adjust)``; x must not be NULL.

    adjust=False: y0 = x0, y = (1-alpha)*y' + alpha*x.  adjust=True: weights normalised by their sum.

    y is a weighted sum over the past whose weights shrink by q = 1 - alpha per row, so a row needs only its own chunk
    and the one before it, a chunk being long enough to forget.  Inside a chunk the sum is a plain running sum of
    x * q^-k scaled by q^k, so no recursion, no Python and no extra shuffle: the chunks lie inside (ticker, _blk).
    """
    todo = sorted(specs.items(), key=lambda kv: -chunk_rows(kv[1][1]))
    while todo:
        size = chunk_rows(todo[0][1][1])
        group = [kv for kv in todo if -math.log(1.0 - kv[1][1]) * size <= _SAFE]
        todo = [kv for kv in todo if kv not in group]
        df = _ewm_chunked(df, dict(group), size)
    return df


def _ewm_chunked(df: DataFrame, specs, size: int) -> DataFrame:
    halo, needs = df.schema[BLK].metadata.get("halo"), max(math.ceil(_FORGET / -math.log(1.0 - a)) for _, a, _ in specs.values())
    if halo is not None and needs > halo:
        raise ValueError(f"a recurrence needs {needs} rows to forget its start, but blocks carry {halo} rows before them")
    chunk, k = F.floor(F.col(POS) / F.lit(size)), F.col(POS) % F.lit(size)
    inside = (Window.partitionBy("ticker", BLK, "_chunk").orderBy("ts")
              .rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_chunk", chunk).withColumn("_k", k)
    local = {}
    for name, (x, alpha, adjust) in specs.items():
        q = 1.0 - alpha
        weight = F.lit(1.0) if adjust else F.when(F.col(POS) == 0, F.lit(1.0)).otherwise(F.lit(alpha))
        total = F.sum(x * weight * F.pow(F.lit(q), -F.col("_k"))).over(inside)
        local[f"_l_{name}"] = total * F.pow(F.lit(q), F.col("_k"))
    df = df.withColumns(local)
    past = _w().rowsBetween(Window.unboundedPreceding, -1)
    out = {}
    for name, (x, alpha, adjust) in specs.items():
        q = 1.0 - alpha
        at_end = F.when(F.col("_k") == size - 1, F.col(f"_l_{name}"))
        prior = F.coalesce(F.last(at_end, ignorenulls=True).over(past), F.lit(0.0))
        y = F.col(f"_l_{name}") + prior * F.pow(F.lit(q), F.col("_k") + 1)
        if adjust:
            y = y * F.lit(alpha) / (F.lit(1.0) - F.pow(F.lit(q), F.col(POS) + 1))
        out[name] = y
    return df.withColumns(out).drop("_chunk", "_k", *local)


def running_sum(df: DataFrame, sums: Mapping[str, Column]) -> DataFrame:
    """Cumulative sums along the whole series: running inside a block plus the total of the blocks before it."""
    if one_block(df):
        return df.withColumns({name: F.sum(x).over(running()) for name, x in sums.items()})
    own = {f"_x_{name}": x for name, x in sums.items()}
    df = df.withColumns(own)
    totals = df.filter(~F.col(HALO)).groupBy("ticker", BLK).agg(*[F.sum(t).alias(t) for t in own])
    before = Window.partitionBy("ticker").orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("ticker", BLK, *[F.coalesce(F.sum(t).over(before), F.lit(0.0)).alias(f"_c{t}") for t in own])
    whole = Window.partitionBy("ticker", BLK)
    # copies from the block before sit ahead of the block's own rows: the level at the first row is the carry minus them
    df = df.withColumn("_p0", F.min(F.when(~F.col(HALO), F.col(POS))).over(whole))
    lead_in = {f"_h{t}": F.coalesce(F.sum(F.when(F.col(POS) < F.col("_p0"), F.col(t))).over(whole), F.lit(0.0)) for t in own}
    df = df.withColumns({**lead_in, **{f"_r{t}": F.sum(t).over(running()) for t in own}}).join(carry, ["ticker", BLK])
    df = df.withColumns({name: F.col(f"_c{t}") - F.col(f"_h{t}") + F.col(f"_r{t}") for name, t in zip(sums, own)})
    return df.drop("_p0", *own, *[f"{k}{t}" for t in own for k in ("_h", "_r", "_c")])
