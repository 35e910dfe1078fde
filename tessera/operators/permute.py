"""Permutations that follow from a key, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half rounds of the network.
ROUNDS = 6


def shuffled_place(place: Column, n: Column, seed: int, *of: str | Column) -> Column:
    """Where the row at ``place`` (0 to ``n`` - 1) stands after a permutation that follows from ``seed`` and ``of`` alone.

    A Feistel network on a grid of a rows and b columns, a b >= n: the row number is moved by a hash of the column number,
    then the column number by a hash of the row number, and so on, so that every half round can be undone. A place that
    falls beyond n is sent on until it does not; as fewer than a cells lie beyond, few rows are, and none for long. A task
    that is lost is made anew alike, and no row needs to know of another. Null where place or n is null."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def sent(x: Column) -> Column:
        row, column = F.floor(x / b).cast("long"), x % b
        for k in range(ROUNDS):
            if k % 2:
                column = F.pmod(column + F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *of, row), b), b)
            else:
                row = F.pmod(row + F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *of, column), a), a)
        return row * b + column

    first = sent(place.cast("long"))
    on = F.aggregate(F.sequence(F.lit(1).cast("long"), a * b - n), first, lambda x, _: F.when(x < n, x).otherwise(sent(x)))
    return F.when(first < n, first).otherwise(on)
