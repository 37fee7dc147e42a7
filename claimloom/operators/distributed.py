"""Order statistics, fills and numbering that keep no group in a single task.

A window over one large group sorts that group in one task. The helpers here
cut a group into blocks of bounded size, summarise the blocks (a small frame)
and combine the summaries with the rows again, so that one key may hold any
share of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from claimloom.session import ensure_checkpoint_dir, kept

BLOCK_ROWS = 65_536
# levels of summaries over the blocks of a group, each over blocks of 2^16
SUMMARY_LEVELS = 1
_UPPER_BITS = 16


def _block(order: str, rows: int) -> Column:
    """Block number by whole division, exact for every 64-bit order number."""
    return F.expr(f"`{order}` div {int(rows)}")


def _before_blocks(
    blocks: DataFrame, group: list[str], before: Mapping[str, Callable[[WindowSpec], Column]],
    whole: Mapping[str, Callable[[str], Column]], join: Callable[[Column, Column], Column], backward: bool, levels: int = SUMMARY_LEVELS,
) -> DataFrame:
    """(group, _block, names): what all earlier blocks of a group hand to each block.

    Blocks are summed up to blocks of 2^16 blocks, ``levels`` times, so
    order numbers far apart make many blocks but no large window: a window at a
    level sees that many rows at most, and the last one the blocks of the top.
    ``before`` gives a name's value over the earlier rows of a window, ``whole``
    that of a whole block, and ``join`` puts the value inside a block and that
    before it together.
    """
    direction = F.desc if backward else F.asc
    if levels == 0:
        window = Window.partitionBy(*group).orderBy(direction("_block")).rowsBetween(Window.unboundedPreceding, -1)
        return blocks.select(*group, "_block", *[over(window).alias(name) for name, over in before.items()])
    placed = blocks.withColumn("_upper", F.shiftright("_block", _UPPER_BITS))
    window = Window.partitionBy(*group, "_upper").orderBy(direction("_block")).rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.select(*group, "_block", "_upper", *[over(window).alias(f"_in_{name}") for name, over in before.items()])
    upper = placed.groupBy(*group, F.col("_upper").alias("_block")).agg(*[of("_block").alias(name) for name, of in whole.items()])
    above = _before_blocks(upper, group, before, whole, join, backward, levels - 1)
    renamed = above.select(*group, F.col("_block").alias("_upper"), *[F.col(name).alias(f"_up_{name}") for name in before])
    return inside.join(renamed, [*group, "_upper"], "left").select(
        *group, "_block", *[join(F.col(f"_in_{name}"), F.col(f"_up_{name}")).alias(name) for name in before]
    )


def carry_last(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    values: Mapping[str, Column],
    block_rows: int = BLOCK_ROWS,
    inclusive: bool = True,
    backward: bool = False,
) -> DataFrame:
    """Add, per row, the last non-null value at or before it in its group.

    ``order`` is an integer column, unique within the group, so a block of
    ``block_rows`` consecutive numbers holds at most that many rows; numbers may
    be any distance apart. ``inclusive=False`` looks only at earlier rows (a lag
    over non-null values); ``backward=True`` looks from the end (a lead).
    """
    group = list(group)
    block = _block(order, block_rows).alias("_block")
    named = df.select("*", block, *[value.alias(f"_v_{name}") for name, value in values.items()])
    direction = F.desc if backward else F.asc

    inside = (
        Window.partitionBy(*group, "_block")
        .orderBy(direction(order))
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    local = named.select(
        "*", *[F.last(f"_v_{name}", ignorenulls=True).over(inside).alias(f"_l_{name}") for name in values]
    )

    # one row per block: the value a later block inherits from this one
    pick = F.min_by if backward else F.max_by

    def end_of(name: str) -> Callable[[str], Column]:
        return lambda at: pick(F.col(name), F.when(F.col(name).isNotNull(), F.col(at)))

    ends = named.groupBy(*group, "_block").agg(*[end_of(f"_v_{name}")(order).alias(f"_c_{name}") for name in values])
    names = [f"_c_{name}" for name in values]
    carried = _before_blocks(
        ends,
        group,
        {c: (lambda window, c=c: F.last(c, ignorenulls=True).over(window)) for c in names},
        {c: end_of(c) for c in names},
        lambda inner, outer: F.coalesce(inner, outer),
        backward,
    )
    joined = local.join(carried, [*group, "_block"], "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[F.coalesce(F.col(f"_l_{name}"), F.col(f"_c_{name}")).alias(name) for name in values],
    )


def running_number(
    df: DataFrame, group: Sequence[str], order: str, out: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Number the rows of each group 1..n by ``order``, an integer unique within the group."""
    group = list(group)
    blocked = df.withColumn("_block", _block(order, block_rows))
    inside = Window.partitionBy(*group, "_block").orderBy(order)
    sizes = blocked.groupBy(*group, "_block").agg(F.count("*").alias("_rows_before"))
    offsets = _before_blocks(
        sizes,
        group,
        {"_rows_before": lambda window: F.coalesce(F.sum("_rows_before").over(window), F.lit(0))},
        {"_rows_before": lambda at: F.sum("_rows_before")},
        lambda inner, outer: inner + outer,
        backward=False,
    )
    numbered = blocked.withColumn("_nth", F.row_number().over(inside)).join(offsets, [*group, "_block"])
    return numbered.select(*[F.col(c) for c in df.columns], (F.col("_rows_before") + F.col("_nth")).alias(out))


BRACKET_VALUES = 50_000  # distinct values of one group that one task ranks
_CUTS = 64
_ACCURACY = 10_000


def exact_median(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    out: str,
    bin_width: float | None = None,
    count_out: str = "value_count",
    weight: str | None = None,
    most: int = BRACKET_VALUES,
) -> DataFrame:
    """Exact median per group as a double, mean of the middle two; groups without a value have no row.

    ``weight`` names a column that says how often a row counts. Equal values are
    counted together first and kept. Where a group has more than ``most`` distinct
    values, a bracket around its middle is narrowed until it holds no more: a
    quantile sketch cuts the bracket, the parts are counted exactly, and the part
    with the middle positions stays. So no task ranks more than ``most`` values
    of a group, whatever their spread. ``bin_width`` has no effect any more.
    """
    group = list(group)
    present = F.col(value).isNotNull()
    times = F.sum(F.when(present, F.col(weight))) if weight else F.count(value)
    # the count leaves missing values out; a filter on the value itself would be
    # pushed below the grouping and work the value out again for every row
    freq = kept(df.groupBy(*group, value).agg(times.alias("_n")).where(F.col("_n") > 0), "values")
    brackets = middle_brackets(freq, group, value, most)
    inside = _inside(freq, brackets, group, value)
    within = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("_last", F.col("_below") + F.sum("_n").over(within))
    hits = ranked.where((F.col("_last") >= _low()) & (F.col("_last") - F.col("_n") < _high()))
    return hits.groupBy(*group).agg(
        ((F.min(value).cast("double") + F.max(value).cast("double")) / F.lit(2.0)).alias(out),
        F.first("_total").alias(count_out),
    )


def _low() -> Column:
    return F.floor((F.col("_total") + 1) / 2)


def _high() -> Column:
    return F.floor(F.col("_total") / 2) + 1


def _inside(freq: DataFrame, brackets: DataFrame, group: list[str], value: str) -> DataFrame:
    """The values of each group's bracket; there is one bracket per group."""
    if not group:
        freq, brackets = freq.withColumn("_all", F.lit(0)), brackets.withColumn("_all", F.lit(0))
    joined = freq.join(brackets, group or ["_all"])
    return joined.where((F.col(value) >= F.col("_from")) & (F.col(value) <= F.col("_to")))


def middle_brackets(freq: DataFrame, group: list[str], value: str, most: int) -> DataFrame:
    """(group, _from, _to, _below, _total, _values): bounds around the middle positions with at most ``most`` distinct values.

    ``freq`` has each value of a group once, with its count ``_n``. ``_below``
    counts the smaller values. Only the largest number of values left reaches
    the driver.
    """
    brackets = kept(
        freq.groupBy(*group).agg(
            F.min(value).alias("_from"), F.max(value).alias("_to"), F.lit(0).cast("bigint").alias("_below"),
            F.sum("_n").alias("_total"), F.count("*").alias("_values"),
        ),
        "brackets",
    )
    while (brackets.agg(F.max("_values")).first()[0] or 0) > most:
        wide = brackets.where(F.col("_values") > most)
        inside = _inside(freq, wide, group, value)
        places = [k / _CUTS for k in range(1, _CUTS)]
        cuts = kept(inside.groupBy(*group).agg(F.percentile_approx(value, places, _ACCURACY).alias("_cuts")), "cuts")
        if not group:
            inside, cuts = inside.withColumn("_all", F.lit(0)), cuts.withColumn("_all", F.lit(0))
        parted = inside.join(cuts, group or ["_all"]).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(value))))
        parts = parted.groupBy(*group, "_part").agg(
            F.min(value).alias("_from"), F.max(value).alias("_to"), F.first("_below").alias("_below"),
            F.first("_total").alias("_total"), F.count("*").alias("_values"), F.sum("_n").alias("_part_n"),
        )
        # at most one row per cut and group
        earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        placed = parts.withColumn("_below", F.col("_below") + F.coalesce(F.sum("_part_n").over(earlier), F.lit(0)))
        middle = placed.where((F.col("_below") + F.col("_part_n") >= _low()) & (F.col("_below") < _high()))
        narrowed = middle.groupBy(*group).agg(
            F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.min("_below").alias("_below"),
            F.first("_total").alias("_total"), F.sum("_values").alias("_values"),
        )
        brackets = kept(brackets.where(F.col("_values") <= most).unionByName(narrowed), "brackets")
    return brackets


def global_position(df: DataFrame, order: Sequence[Column], out: str = "position") -> DataFrame:
    """Number the rows 1..n in a total order, with the sort spread over all tasks.

    The sorted frame is written to the checkpoint folder first: the row ids
    come from the sort's partitions, so they must not be computed twice. Only
    one count per partition is then summed up.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    stored = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright(F.col("_id"), 33)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    # one row per sort partition, so its size is bounded by the partition count
    numbered = stored.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    in_part = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.select(*[F.col(c) for c in df.columns], (F.col("_offset") + in_part + 1).alias(out))


# --- order index -------------------------------------------------------------------

RANGE_ROWS = 50_000  # rows of an order range, about
_SAMPLE_PER_RANGE = 50
_MOST_RANGES = 4096
_FAN = 16  # bounds that a row meets at one of three levels; its cube is the most ranges


@dataclass(frozen=True)
class OrderKey:
    """One part of a total order."""

    value: Column
    descending: bool = False
    nulls_last: bool = False

    def sort(self) -> Column:
        if self.descending:
            return self.value.desc_nulls_last() if self.nulls_last else self.value.desc_nulls_first()
        return self.value.asc_nulls_last() if self.nulls_last else self.value.asc_nulls_first()

    def after(self, mark: Column, value: Column) -> tuple[Column, Column]:
        """Whether a row stands after a bound in this part, and whether they are level; ``mark`` says that the bound is missing."""
        missing = self.value.isNull()
        level = missing & mark | F.coalesce(self.value == value, F.lit(False))
        behind = F.coalesce(self.value < value if self.descending else self.value > value, F.lit(False))
        apart = missing & ~mark if self.nulls_last else ~missing & mark
        return behind | apart, level


@dataclass(frozen=True)
class OrderIndex:
    """Bounds that cut an order into ranges, and the exact number of rows in each."""

    order: tuple[OrderKey, ...]
    bounds: tuple[tuple, ...]
    sizes: tuple[int, ...]
    types: tuple[DataType, ...]

    @property
    def total(self) -> int:
        return sum(self.sizes)

    def range_of(self) -> Column:
        """Number of a row's range: how many bounds it stands after."""
        if not self.bounds:
            return F.lit(0)
        # the last bound of every block of 256, of 16 and of 1: a row meets a few bounds of each, not all
        levels = F.array(*[
            F.struct(F.lit(width).alias("width"), F.array(*[self._mark(b) for b in self.bounds[width - 1 :: width]]).alias("marks"))
            for width in (_FAN**2, _FAN, 1)
            if width <= len(self.bounds)
        ])

        def narrowed(found: Column, level: Column) -> Column:
            near = F.slice(level["marks"], (found / level["width"]).cast("int") + 1, F.lit(_FAN))
            return found + F.size(F.filter(near, self._passed)) * level["width"]

        return F.aggregate(levels, F.lit(0), narrowed)

    def _mark(self, bound: tuple) -> Column:
        return F.struct(*[
            part
            for k, (v, t) in enumerate(zip(bound, self.types))
            for part in (F.lit(v is None).alias(f"m{k}"), F.lit(v).cast(t).alias(f"v{k}"))
        ])

    def _passed(self, mark: Column) -> Column:
        """Whether a row stands after a bound."""
        found, level = F.lit(False), F.lit(True)
        for k, key in enumerate(self.order):
            after, equal = key.after(mark[f"m{k}"], mark[f"v{k}"])
            found, level = found | level & after, level & equal
        return found

    def within(self, low: int, high: int) -> Column:
        """Whether a row lies in the ranges ``low`` to ``high``; looks at their two outer bounds only."""
        inside = F.lit(True)
        if low > 0:
            inside = inside & self._passed(self._mark(self.bounds[low - 1]))
        if high < len(self.bounds):
            inside = inside & ~self._passed(self._mark(self.bounds[high]))
        return inside

    def ranges(self, first: int, last: int) -> tuple[int, int, int]:
        """The ranges that hold the positions ``first`` to ``last``, counted from 0, and the rows before them."""
        ends = list(accumulate(self.sizes))
        low = next((k for k, end in enumerate(ends) if end > first), len(ends) - 1)
        high = next((k for k, end in enumerate(ends) if end > last), len(ends) - 1)
        return low, high, ends[low] - self.sizes[low]


def order_index(rows: DataFrame, order: Sequence[OrderKey], range_rows: int = RANGE_ROWS) -> OrderIndex:
    """Cuts ``order`` into ranges of about ``range_rows`` rows.

    Bounds come from a sample of bounded size by the hash of the keys; equal keys
    stay in one range. The sizes are counted over all rows. Only bounds and sizes
    reach the driver, at most ``_MOST_RANGES`` of them.
    """
    order = tuple(order)
    keys = rows.select(*[key.value.alias(f"k{n}") for n, key in enumerate(order)])
    types = tuple(f.dataType for f in keys.schema)
    total = rows.count()
    ranges = min(_MOST_RANGES, -(-total // range_rows))
    if ranges <= 1:
        return OrderIndex(order, (), (total,), types)
    step = max(1, total // (ranges * _SAMPLE_PER_RANGE))
    sample = keys.where(F.pmod(F.xxhash64(*keys.columns, F.lit(7)), F.lit(step)) == 0)
    sorting = [OrderKey(F.col(f"k{n}"), key.descending, key.nulls_last).sort() for n, key in enumerate(order)]
    # the sample has a bounded number of rows
    tiles = sample.withColumn("tile", F.ntile(ranges).over(Window.orderBy(*sorting)))
    ends = tiles.withColumn("nth", F.row_number().over(Window.partitionBy("tile").orderBy(*[_flipped(k, n).sort() for n, k in enumerate(order)])))
    found = ends.where((F.col("nth") == 1) & (F.col("tile") < ranges)).orderBy("tile").select(*keys.columns).collect()
    bounds = tuple(dict.fromkeys(tuple(r) for r in found))
    cut = OrderIndex(order, bounds, (), types)
    sizes = {r[0]: r[1] for r in rows.groupBy(cut.range_of().alias("r")).count().collect()}
    return OrderIndex(order, bounds, tuple(sizes.get(k, 0) for k in range(len(bounds) + 1)), types)


def _flipped(key: OrderKey, n: int) -> OrderKey:
    return OrderKey(F.col(f"k{n}"), not key.descending, not key.nulls_last)


def ordered_slice(rows: DataFrame, index: OrderIndex, first: int, count: int) -> DataFrame:
    """``count`` rows from position ``first`` (from 0) on, with their ``position`` from 1; sorts the ranges of these rows only."""
    low, high, before = index.ranges(first, first + count - 1)
    part = rows.where(index.within(low, high)) if index.bounds else rows
    sorting = [key.sort() for key in index.order]
    taken = part.orderBy(*sorting).offset(first - before).limit(count)
    # no more than ``count`` rows
    return taken.withColumn("position", F.lit(first).cast("bigint") + F.row_number().over(Window.orderBy(*sorting)))


def indexed_position(rows: DataFrame, index: OrderIndex, out: str = "position") -> DataFrame:
    """Numbers all rows 1..n; each range is sorted by itself, and nothing is written."""
    starts = [0, *accumulate(index.sizes)][:-1]
    offsets = F.array(*[F.lit(s).cast("bigint") for s in starts])
    placed = rows.withColumn("_range", index.range_of())
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*[key.sort() for key in index.order]))
    return placed.withColumn(out, F.get(offsets, F.col("_range")) + nth).drop("_range")


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """First ``limit`` rows of each group.

    Spark keeps only ``limit`` rows per group in every map task before the
    shuffle, so a large group never reaches one task whole.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= limit)
