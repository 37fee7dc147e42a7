"""Joins of days with ranges of days by equality: ranges are cut into aligned blocks.

A range of n days is the union of at most 2 log2(n) blocks of 2^k days that
begin at a multiple of 2^k. A day lies in one block of each size. So a range
meets exactly the days inside it, each of them once, when both sides are joined
on the size and the number of their blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 22  # block sizes from a day to 2^21 days, which is more than 5,000 years
_ORIGIN = 1 << 21  # keeps day numbers positive from the year -3771 on


def day_number(day: Column) -> Column:
    return F.unix_date(day) + _ORIGIN


def _block(level: int, number: Column) -> Column:
    return F.struct(F.lit(level).cast("int").alias("level"), number.cast("bigint").alias("block"))


def range_blocks(first: Column, last: Column, levels: int = LEVELS) -> Column:
    """The blocks of the days from ``first`` to ``last``, both included; none where a bound is missing or they are swapped.

    ``levels`` sizes suffice for ranges below 2^levels days; a larger range has
    several blocks of the largest size.
    """
    low, end = day_number(first), day_number(last) + 1
    parts = []
    for k in range(levels):
        size = 1 << k
        # bounds in blocks of this size, without what smaller blocks hold already
        left, right = F.floor((low + (size - 1)) / size), F.floor(end / size)
        open_ = left < right
        if k == levels - 1:
            numbers = F.when(open_, F.sequence(left, right - 1)).otherwise(F.array().cast("array<bigint>"))
            parts.append(F.transform(numbers, lambda n: _block(levels - 1, n)))
            continue
        begins, ends = open_ & (left % 2 == 1), open_ & (right % 2 == 1)
        parts.append(F.filter(F.array(F.when(begins, _block(k, left)), F.when(ends, _block(k, right - 1))), lambda b: b.isNotNull()))
    return F.when(first.isNotNull() & last.isNotNull(), F.flatten(F.array(*parts)))


def day_blocks(day: Column, levels: int = LEVELS) -> Column:
    """The block of every size that holds a day; none for a missing day."""
    number = day_number(day)
    return F.when(day.isNotNull(), F.array(*[_block(k, F.shiftright(number, k)) for k in range(levels)]))


def levels_for(most_days: int) -> int:
    """Sizes that ranges of up to so many days need."""
    return max(1, min(LEVELS, int(most_days).bit_length()))


def join_days(
    ranges: DataFrame, days: DataFrame, keys: Sequence[str], first: str, last: str, day: str, levels: int = LEVELS
) -> DataFrame:
    """Pairs of a range and a day inside it that agree on ``keys``, each pair once.

    ``levels`` has to be the same as the longest range needs, or more
    (``levels_for``); longer ranges still meet all their days, by more blocks.
    """
    cut = ranges.withColumn("_b", F.explode(range_blocks(F.col(first), F.col(last), levels)))
    placed = days.withColumn("_b", F.explode(day_blocks(F.col(day), levels)))
    by = [*keys, "_level", "_block"]
    left = cut.withColumns({"_level": F.col("_b.level"), "_block": F.col("_b.block")}).drop("_b")
    right = placed.withColumns({"_level": F.col("_b.level"), "_block": F.col("_b.block")}).drop("_b")
    return left.join(right, by).drop("_level", "_block")
