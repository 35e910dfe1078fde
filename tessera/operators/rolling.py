"""Windows over a group's calendar."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def past(n: int, keys=("grp",), order: str = "t_idx", skip: int = 0):
    """The ``n`` rows that end ``skip`` rows before the current one (0: with it)."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1) - skip, -skip)


def so_far(keys=("grp",), order: str = "t_idx"):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def in_order(keys=("grp",), order: str = "t_idx"):
    return Window.partitionBy(*keys).orderBy(order)


def full(value: Column, counted: Column, w, n: int) -> Column:
    """An aggregate over a frame, null unless the frame holds ``n`` values."""
    return F.when(F.count(counted).over(w) >= n, value)


def rolling_mean(x: Column, n: int, **k) -> Column:
    w = past(n, **k)
    return full(F.avg(x).over(w), x, w, n)


def rolling_std(x: Column, n: int, **k) -> Column:
    w = past(n, **k)
    return full(F.stddev_samp(x).over(w), x, w, n)


def expanding_quantile(df: DataFrame, x: str, q: float, out: str, least: int = 60, keys=("grp",), order: str = "t_idx") -> DataFrame:
    """``df`` with ``out``, the linearly interpolated quantile of all values of ``x`` so far, null before ``least`` values.

    One ordered pass over each group with the values so far kept in order; a growing frame would sort them at every row.
    Null and NaN values do not count.
    """
    fields = [*df.schema.fields, T.StructField(out, T.DoubleType())]
    at = [df.columns.index(k) for k in keys]
    value = df.columns.index(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            made = []
            for key, v in zip(zip(*(batch.column(i).to_pylist() for i in at), strict=True), batch.column(value).to_pylist(), strict=True):
                if key != now:
                    now, held = key, []
                if v is not None and v == v:
                    bisect.insort(held, v)
                if len(held) < least or not held:
                    made.append(None)
                    continue
                place = q * (len(held) - 1)
                low = int(place)
                made.append(held[low] + (held[min(low + 1, len(held) - 1)] - held[low]) * (place - low))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], names=[*batch.schema.names, out])

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, T.StructType(fields))


def equity(r: Column, **k) -> Column:
    return F.product(1 + r).over(so_far(**k))


def hold(raw: Column, number: Column, every: int, **k) -> Column:
    """The last value set on a rebalancing row (number divisible by ``every``)."""
    return F.last(F.when(number % every == 0, raw), ignorenulls=True).over(so_far(**k))


def z_score(x: Column, n: int, pop: bool = False, **k) -> Column:
    w = past(n, **k)
    if pop:
        return full((x - F.avg(x).over(w)) / (F.stddev_pop(x).over(w) + 1e-9), x, w, n)
    return full(F.try_divide(x - F.avg(x).over(w), F.stddev_samp(x).over(w)), x, w, n)
