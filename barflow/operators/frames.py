"""Row windows of many lengths over a blocked series, computed batch by batch with numpy.

Spark's frames add up a window anew for every row and keep a copy of the whole row for each length. Here Spark cuts, deals and sorts the rows as for any window, and
each sorted partition passes once through Arrow; a batch keeps the last rows of the one before it, so a task holds one batch and no series.
Sums run from the oldest row to the newest, as Spark's do, so that values are the same to the last bit."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from barflow.operators import series as S

AT = "_at"      # 0-based row in the block, copies included
Spec = tuple    # kind, column or its name, rows[, skip]


def add(df: DataFrame, *levels: Mapping[str, Spec] | Mapping[str, Column] | list[str]) -> DataFrame:
    """Blocked frame -> the same with more columns, level by level. A level is either windows, name -> (kind, x, n[, skip]) over the last n rows that end ``skip``
    rows before the current one, plain columns that read what is there by then, or names of columns to drop, since every column goes through Arrow.

    Kinds mean, std (sample), std_pop, min, max, mad (mean absolute deviation), rank (of the newest, in (0, 1], ties averaged) are NULL until n values are present;
    some_mean and some_max take the values there are; lag is the value n rows back; ewm and ewm_adjusted are the means of ``series.ewm`` with n for alpha. The levels
    follow each other without a shuffle. Spark does not know the order of what comes out of Arrow, so a window over the result is a shuffle of its rows."""
    S.check_reach(df)
    df = df.withColumn(AT, F.row_number().over(S._w()) - 1)
    for level in levels:
        if isinstance(level, list):
            df = df.drop(*level)
        else:
            df = _windows(df, level) if isinstance(next(iter(level.values())), tuple) else df.withColumns(level)
    return df.drop(AT)


def _windows(df: DataFrame, level: Mapping[str, Spec]) -> DataFrame:
    plan, own, doubles = [], {}, {f.name for f in df.schema if f.dataType == DoubleType()}
    for name, (kind, x, n, *skip) in level.items():
        at = x if isinstance(x, str) else f"_x_{name}"
        if at not in doubles:
            own[at] = (F.col(x) if isinstance(x, str) else x).cast("double")
        rows = S.chunk_rows(n) if kind.startswith("ewm") else n + 1 if kind == "lag" else n
        plan.append((name, kind, at, rows, *(skip or [0]), n))
    reach, known = max(rows + skip for _, _, _, rows, skip, _ in plan), df.schema[S.BLK].metadata
    if reach - 1 > known.get("halo", reach):
        raise ValueError(f"a window reaches {reach - 1} rows, but blocks carry {known['halo']} rows before them")
    kept = [f for f in df.schema if f.name not in level]
    schema = StructType(kept + [StructField(name, DoubleType()) for name in level])
    rows = df.select(*[f.name for f in kept if f.name not in own], *[F.col(f.name).alias(f"_k_{f.name}") for f in kept if f.name in own], *[x.alias(at) for at, x in own.items()])
    keep = [f"_k_{f.name}" if f.name in own else f.name for f in kept]
    out = rows.mapInArrow(_runner(plan, sorted({at for _, _, at, *_ in plan} | {AT, S.POS}), keep, schema.names, reach), schema)
    return out.withMetadata(S.BLK, known)


def _runner(plan: list[tuple], inputs: list[str], keep: list[str], names: list[str], reach: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    window, at, pos = _kernel(), AT, S.POS

    def run(batches):
        tail = {x: (np.zeros(reach), np.zeros(reach, bool)) for x in inputs}
        for batch in batches:
            if not batch.num_rows:
                continue
            for x in inputs:
                col = batch.column(batch.schema.get_field_index(x))
                there = col.is_valid().to_numpy(zero_copy_only=False)
                values = col.fill_null(0).to_numpy()
                tail[x] = np.concatenate([tail[x][0], values]), np.concatenate([tail[x][1], there])
            arrays = [batch.column(batch.schema.get_field_index(k)) for k in keep]
            with np.errstate(all="ignore"):
                for _, kind, x, n, skip, alpha in plan:
                    value, there = window(kind, *tail[x], tail[at][0], tail[pos][0], batch.num_rows, n, skip, alpha)
                    arrays.append(pa.array(value, pa.float64(), mask=~there))
            yield pa.RecordBatch.from_arrays(arrays, names=names)
            tail = {x: (v[-reach:], t[-reach:]) for x, (v, t) in tail.items()}
    return run


def _kernel() -> Callable[..., tuple[np.ndarray, np.ndarray]]:
    """The function of one window; made here, so that it travels to the workers by value."""
    def window(kind, x, there, at, pos, rows, n, skip, alpha):
        """Values and presence for the last ``rows`` rows of ``x``; ``there`` marks values that are not NULL, ``at`` counts the rows of the block before and
        ``pos`` those of the series."""
        end = len(x)

        def back(a, k):
            return a[end - rows - k:end - k]
        if kind in ("ewm", "ewm_adjusted"):     # weights shrink by q a row: sums over 1, 2, 4, ... rows until older ones weigh nothing
            q, s = 1.0 - alpha, 1
            y = x if kind == "ewm_adjusted" else np.where(pos == 0, x, alpha * x)
            while s < n:
                y = np.concatenate([y[:s], y[s:] + np.where(at[s:] >= s, q ** s * y[:-s], 0.0)])
                s *= 2
            if kind == "ewm_adjusted":
                y = y * alpha / (1.0 - q ** (pos + 1.0))
            return back(y, skip), back(there, skip) & (back(at, 0) >= skip)
        at = back(at, 0)
        if kind == "lag":
            return back(x, n - 1), back(there, n - 1) & (at >= n - 1)
        steps = [k + skip for k in range(n - 1, -1, -1)]      # from the oldest row to the newest
        if kind in ("some_mean", "some_max"):
            total, count, top = np.zeros(rows), np.zeros(rows), np.full(rows, -np.inf)
            for k in steps:
                own = back(there, k) & (at >= k)
                total, count = np.where(own, total + back(x, k), total), count + own
                top = np.where(own, np.maximum(top, back(x, k)), top)
            return (total / count if kind == "some_mean" else top), count > 0
        gaps = np.concatenate([[0], np.cumsum(~there)])
        whole = (gaps[end - rows - skip + 1:end - skip + 1] == gaps[end - rows - skip - n + 1:end - skip - n + 1]) & (at >= n - 1 + skip)
        if kind in ("mean", "mad"):
            value = np.zeros(rows)
            for k in steps:
                value = value + back(x, k)
            value = value / n
            if kind == "mad":
                middle, value = value, np.zeros(rows)
                for k in steps:
                    value = value + np.abs(back(x, k) - middle)
                value = value / n
        elif kind in ("std", "std_pop"):
            mean, squares = np.zeros(rows), np.zeros(rows)
            for count, k in enumerate(steps, 1):
                delta = back(x, k) - mean
                step = delta / count
                mean, squares = mean + step, squares + delta * (delta - step)
            value = np.sqrt(squares / (n - 1 if kind == "std" else n))
        elif kind in ("min", "max"):
            pick = np.fmin if kind == "min" else np.maximum      # a NaN is above every number, as in Spark
            value = back(x, steps[0])
            for k in steps[1:]:
                value = pick(value, back(x, k))
        elif kind == "rank":
            if np.isnan(x).any():
                x = np.unique(x, return_inverse=True)[1]
            less, same, newest = np.zeros(rows), np.zeros(rows), back(x, skip)
            for k in steps:
                less, same = less + (back(x, k) < newest), same + (back(x, k) == newest)
            value = (less + (same + 1) / 2) / n
        else:
            raise ValueError(kind)
        return value, whole
    return window
