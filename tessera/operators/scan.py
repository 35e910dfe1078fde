"""Running values of long groups, scanned in blocks.

A window without a beginning keeps a whole group in one task. Here a group's line is cut into blocks of ``size`` steps of
its order column. Every block is scanned for itself, by (keys, block); one row a block, its whole effect, is scanned over
the blocks in front; what comes out is joined back to the block's rows, which already lie by (keys, block). So a group of
10^7 rows runs in as many tasks as there are, and only its 10^7 / ``size`` block ends meet.

What the functions have in common: ``order`` is a whole number, unique in its group, gaps allowed. Null values take no part
and keep the state; rows before the first value have null. NaN is a value like any other: it stays from then on, except in
``hold``. Rows with a null key or order stand alone in no line: they get null. Other columns are kept; empty table: no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps of a block; fewer for a recurrence, which looks back once for each doubling.
SIZE, SHORT = 4096, 256


def _free(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


class _Blocks:
    """A frame whose rows are told their block, and what the blocks in front of theirs come to."""

    def __init__(self, df: DataFrame, keys: tuple[str, ...], order: str, size: int):
        self.keys, self.order, self.wanted = keys, order, list(df.columns)
        self.block = _free(df, "block_")
        self.rows = df.withColumn(self.block, F.col(order) - F.pmod(F.col(order), F.lit(size)))
        self.inside = Window.partitionBy(*keys, self.block).orderBy(order)
        self.so_far = self.inside.rowsBetween(Window.unboundedPreceding, 0)
        line = Window.partitionBy(*keys).orderBy(self.block)
        self.in_front = line.rowsBetween(Window.unboundedPreceding, -1)
        self.line = line

    def add(self, name: str, value: Column) -> str:
        name = _free(self.rows, name)
        self.rows = self.rows.withColumn(name, value)
        return name

    def ends(self, **whole: Column) -> DataFrame:
        """One row a block, with aggregates of its rows."""
        return self.rows.groupBy(*self.keys, self.block).agg(*[v.alias(k) for k, v in whole.items()])

    def carry(self, ends: DataFrame, **before: Column) -> list[str]:
        """Give every row what ``before`` makes of the ends of the blocks in front; the names of the new columns."""
        names = [_free(self.rows, f"carry_{k}_") for k in before]
        ends = ends.select(*self.keys, self.block, *[v.alias(n) for n, v in zip(names, before.values(), strict=True)])
        self.rows = self.rows.join(ends, [*self.keys, self.block], "left")
        return names

    def out(self, **made: Column) -> DataFrame:
        there = F.col(self.order).isNotNull()
        for k in self.keys:
            there = there & F.col(k).isNotNull()
        return self.rows.select(*[F.col(f"`{c}`") for c in self.wanted if c not in made], *[F.when(there, v).alias(k) for k, v in made.items()])


def place(df: DataFrame, out: str, keys: tuple[str, ...] = ("grp",), order: str = "t_idx", size: int = SIZE) -> DataFrame:
    """``df`` with ``out``: how many rows of the group come before the row."""
    b = _Blocks(df, keys, order, size)
    (before,) = b.carry(b.ends(c=F.count("*")), c=F.sum("c").over(b.in_front))
    return b.out(**{out: F.coalesce(F.col(before), F.lit(0)) + F.row_number().over(b.inside) - 1})


def _times(a: Column, b: Column) -> Column:
    return F.coalesce(a * b, a, b)


def equity(df: DataFrame, r: str, out: str = "cum", keys: tuple[str, ...] = ("grp",), order: str = "t_idx", size: int = SIZE) -> DataFrame:
    """``df`` with ``out``: the product of 1 + ``r`` so far."""
    b = _Blocks(df, keys, order, size)
    (before,) = b.carry(b.ends(p=F.product(1 + F.col(r))), p=F.product("p").over(b.in_front))
    return b.out(**{out: _times(F.col(before), F.product(1 + F.col(r)).over(b.so_far))})


def drawdown(df: DataFrame, r: str, cum: str = "cum", dd: str = "dd", keys: tuple[str, ...] = ("grp",), order: str = "t_idx", size: int = SIZE) -> DataFrame:
    """``df`` with ``cum``, the product of 1 + ``r`` so far, and ``dd``, its share of its own greatest value so far, less 1
    (null where that is 0)."""
    b = _Blocks(df, keys, order, size)
    (before,) = b.carry(b.ends(p=F.product(1 + F.col(r))), p=F.product("p").over(b.in_front))
    own = b.add("own_", _times(F.col(before), F.product(1 + F.col(r)).over(b.so_far)))
    (top,) = b.carry(b.ends(m=F.max(own)), m=F.max("m").over(b.in_front))
    return b.out(**{cum: F.col(own), dd: F.try_divide(F.col(own), F.greatest(F.col(top), F.max(own).over(b.so_far))) - 1})


def hold(df: DataFrame, value: Column, out: str, keys: tuple[str, ...] = ("grp",), order: str = "t_idx", size: int = SIZE) -> DataFrame:
    """``df`` with ``out``: the last ``value`` so far that is not null, for a value that is set on some rows only."""
    b = _Blocks(df, keys, order, size)
    v = b.add("value_", value)
    last = F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order)))
    (before,) = b.carry(b.ends(v=last), v=F.last("v", ignorenulls=True).over(b.in_front))
    return b.out(**{out: F.coalesce(F.last(v, ignorenulls=True).over(b.so_far), F.col(before))})


def _after(s: Column, a: Column, b: Column, s0: Column, a0: Column, b0: Column) -> tuple[Column, Column, Column]:
    """The steps (s0, a0, b0) and then (s, a, b) as one; no steps (nulls) in front leave the others as they are."""
    return F.when(s0.isNotNull(), a + b * s0).otherwise(s), a + b * F.coalesce(a0, F.lit(0.0)), b * F.coalesce(b0, F.lit(1.0))


def _doubled(df: DataFrame, line, steps: int) -> DataFrame:
    """s, a, b of every row joined with those of up to 2^``steps`` - 1 rows in front of it on ``line``."""
    for k in range(steps):
        back = [F.lag(x, 1 << k).over(line) for x in ("s", "a", "b")]
        df = df.withColumns(dict(zip(("s0", "a0", "b0"), back, strict=True)))
        df = df.withColumns(dict(zip(("s", "a", "b"), _after(*map(F.col, ("s", "a", "b", "s0", "a0", "b0"))), strict=True))).drop("s0", "a0", "b0")
    return df


def recurrence(df: DataFrame, x: str, new: float, old: float, out: str, keys: tuple[str, ...] = ("grp",), order: str = "t_idx", size: int = SHORT) -> DataFrame:
    """``df`` with ``out``: v = ``x`` on the first row that has one, then v = ``new`` * ``x`` + ``old`` * the v before.

    A stretch of rows is a map: s is what it comes to if nothing is in front, a + b v if v is. Two stretches make one, so
    that a row's own stretch back to the beginning of its block takes log2(``size``) doublings, all on the same sorted
    rows; the ends of the blocks double in the same way, as often as the longest group has blocks (one number is asked)."""
    if clash := {"s", "a", "b", "s0", "a0", "b0"} & {c.lower() for c in df.columns}:
        held = {c: f"held_{i}_{c}" for i, c in enumerate(df.columns) if c.lower() in clash}
        names = lambda c: held.get(c, c)
        made = recurrence(df.withColumnsRenamed(held), names(x), new, old, "held_out_", tuple(map(names, keys)), names(order), size)
        return made.withColumnsRenamed({v: k for k, v in held.items()}).select(*[F.col(f"`{c}`") for c in df.columns if c != out], F.col("held_out_").alias(out))
    k = _Blocks(df, keys, order, size)
    v = F.col(x).cast("double")
    k.rows = k.rows.withColumns({"s": v, "a": F.coalesce(v * new, F.lit(0.0)), "b": F.when(v.isNotNull(), F.lit(float(old))).otherwise(1.0)})
    k.rows = _doubled(k.rows, k.inside, math.ceil(math.log2(max(2, size))))
    last = F.max_by(F.struct("s", "a", "b"), F.col(order))
    ends = k.ends(e=last).select(*keys, k.block, "e.*")
    longest = ends.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    ends = _doubled(ends, k.line, math.ceil(math.log2(max(2, longest))))
    (front,) = k.carry(ends, v=F.lag("s").over(k.line))
    return k.out(**{out: F.when(F.col(front).isNotNull(), F.col("a") + F.col("b") * F.col(front)).otherwise(F.col("s"))})
