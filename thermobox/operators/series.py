"""Operators on ordered per-time tables, without putting a series into one task.

A series is stored once, range-partitioned and sorted by its key, and each row gets
its global position from the partition it lies in. Windows then run per block of
consecutive positions; rows near a block border are copied to the neighbour block so
that every frame is complete. Running sums take the totals of the blocks before them.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermobox.functions.columns import seconds_between
from thermobox.session import materialise

# monotonically_increasing_id: partition number above bit 33, row number below.
_ROW_BITS = 33
BLOCK_ROWS = 8192


@dataclass(frozen=True)
class Series:
    """A table with `step`, the position of the row in key order, counted from 0."""

    frame: DataFrame
    length: int
    block: int
    key: str = "time"

    @property
    def blocks(self) -> int:
        return max(1, math.ceil(self.length / self.block))

    def map(self, frame: DataFrame) -> Series:
        """The same positions with other columns."""
        return replace(self, frame=frame)


def index_by(
    df: DataFrame, key: str = "time", ties: Sequence[str] = (), block_rows: int = BLOCK_ROWS
) -> Series:
    """Store `df` in key order and number its rows; `ties` order rows of equal key.

    Ties also take part in the partitioning, so that one frequent key does not fill a task.

    Only the row count of each stored partition comes to the driver: at most
    spark.sql.shuffle.partitions numbers.
    """
    located = materialise(
        df.repartitionByRange(key, *ties)
        .sortWithinPartitions(key, *ties)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", _ROW_BITS)
    sizes = {r[0]: r[1] for r in located.groupBy(part.alias("part")).count().collect()}
    starts, length = {}, 0
    for number in sorted(sizes):
        starts[number] = length
        length += sizes[number]
    row = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    step = row
    if length and set(starts) != {0}:
        pairs = [F.lit(v).cast("long") for pair in starts.items() for v in pair]
        step = row + F.element_at(F.create_map(*pairs), part)
    return Series(located.withColumn("step", step).drop("_at"), length, block_rows, key)


def _framed(series: Series, before: int, after: int) -> tuple[DataFrame, Column]:
    """Rows with `_block`, border rows copied so that frames [-before, after] are complete."""
    step, size = F.col("step"), F.lit(series.block)
    own = F.floor(step / size)
    first = F.greatest(F.floor((step - F.lit(after)) / size), F.lit(0))
    last = F.least(F.floor((step + F.lit(before)) / size), F.lit(series.blocks - 1))
    spread = series.frame.withColumn("_block", F.explode(F.sequence(first, last)))
    return spread, F.col("_block") == own


def with_neighbours(series: Series, values: Mapping[str, tuple[int, str]], group: str) -> DataFrame:
    """Rows with, for each {output: (shift, input)}, the input of the row that many places on, NULL beyond the row's `group`."""
    reach = [shift for shift, _ in values.values()]
    frame, own = _framed(series, max(0, -min(reach)), max(0, max(reach)))
    near = Window.partitionBy("_block").orderBy("step")
    found = {
        out: F.when(F.lead(group, shift).over(near) == F.col(group), F.lead(name, shift).over(near))
        for out, (shift, name) in values.items()
    }
    return frame.withColumns(found).where(own).drop("_block")


def _is_numeric(df: DataFrame, key: str) -> bool:
    return isinstance(df.schema[key].dataType, T.NumericType)


def centered_difference(series: Series, rates: Mapping[str, str]) -> Series:
    """(f[i+1] - f[i-1]) / (t[i+1] - t[i-1]) for each {output: input}; both end rows drop out.

    Seconds when the key is a timestamp, its own unit when it is a number.
    """
    frame, own = _framed(series, 1, 1)
    near = Window.partitionBy("_block").orderBy("step")
    key = series.key
    elapsed = seconds_between(F.lag(key).over(near), F.lead(key).over(near), _is_numeric(frame, key))
    slopes = {
        out: F.try_divide(F.lead(name).over(near) - F.lag(name).over(near), elapsed)
        for out, name in rates.items()
    }
    inner = (F.col("step") > 0) & (F.col("step") < series.length - 1)
    return series.map(frame.withColumns(slopes).where(own & inner).drop("_block"))


def rolling_mean(series: Series, names: Sequence[str], window: int) -> Series:
    """Centred mean over `window` rows, NULL unless all of them are present.

    An even window reaches one row further back than ahead.
    """
    if window == 1:
        return series
    before, after = window // 2, window - 1 - window // 2
    frame, own = _framed(series, before, after)
    span = Window.partitionBy("_block").orderBy("step").rowsBetween(-before, after)
    means = {
        name: F.when(F.count(name).over(span) == window, F.avg(name).over(span)) for name in names
    }
    return series.map(frame.withColumns(means).where(own).drop("_block"))


def _before(sums: DataFrame, names: Sequence[str], part: str, order: str) -> DataFrame:
    """`sums` with _name, the sum of each name over the earlier rows of the same `part`."""
    earlier = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumns({f"_{name}": F.coalesce(F.sum(name).over(earlier), F.lit(0.0)) for name in names})


def running_sum(series: Series, totals: Mapping[str, Column]) -> Series:
    """Sum of each {output: expression} up to and including the row; missing values count as 0.

    Totals go up two levels: rows to blocks, blocks to groups of as many blocks. A window sees one block,
    one group, or all groups, of which a series of 8192^3 rows has 8192.
    """
    step, size = F.col("step"), F.lit(series.block)
    names = list(totals)
    frame = series.frame.withColumns(dict(totals)).withColumn("_block", F.floor(step / size))
    upto = (
        Window.partitionBy("_block").orderBy("step")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    within = frame.withColumns({name: F.coalesce(F.sum(name).over(upto), F.lit(0.0)) for name in names})
    blocks = frame.groupBy("_block").agg(*[F.sum(name).alias(name) for name in names])
    blocks = blocks.withColumn("_group", F.floor(F.col("_block") / size))
    groups = blocks.groupBy("_group").agg(*[F.sum(name).alias(name) for name in names]).withColumn("_all", F.lit(0))
    of_groups = _before(groups, names, "_all", "_group").select("_group", *[F.col(f"_{n}").alias(f"_group_{n}") for n in names])
    of_blocks = _before(blocks, names, "_group", "_block").join(of_groups, "_group")
    carried = of_blocks.select("_block", *[(F.col(f"_{n}") + F.col(f"_group_{n}")).alias(f"_{n}") for n in names])
    joined = within.join(carried, "_block")
    return series.map(
        joined.withColumns({name: F.col(name) + F.col(f"_{name}") for name in names})
        .drop("_block", *[f"_{name}" for name in names])
    )


def step_seconds(series: Series) -> DataFrame:
    """Seconds between the first two rows of a whole series, as one row `dt`; NULL with fewer than two."""
    first = series.frame.where(F.col("step") < 2)
    elapsed = seconds_between(F.min(series.key), F.max(series.key), _is_numeric(series.frame, series.key))
    return first.agg(F.when(F.count(series.key) == 2, elapsed.cast("double")).alias("dt"))


def daily(df: DataFrame, means: Sequence[str] = (), sums: Mapping[str, Column] | None = None) -> DataFrame:
    """Calendar-day means and sums; a sum over no value is 0."""
    day = F.to_date("time").cast("timestamp_ntz").alias("day")
    return df.groupBy(day).agg(
        *[F.avg(name).alias(name) for name in means],
        *[F.coalesce(F.sum(expr), F.lit(0.0)).alias(name) for name, expr in (sums or {}).items()],
    )


def quantiles(series: Series, probabilities: Sequence[float]) -> DataFrame:
    """Exact quantiles (linear between ranks) of the key of an indexed series, as one row.

    The needed ranks are known from the length, so only those rows are looked at.
    """
    if series.length == 0:
        return series.frame.agg(*[F.lit(None).cast("double").alias(f"q{i}") for i in range(len(probabilities))])
    spots = [p * (series.length - 1) for p in probabilities]
    ranks = sorted({rank for spot in spots for rank in (math.floor(spot), math.ceil(spot))})
    picked = series.frame.where(F.col("step").isin(*ranks))

    def at(rank: int) -> Column:
        return F.max(F.when(F.col("step") == rank, F.col(series.key)))

    return picked.agg(
        *[
            (at(math.floor(s)) + (at(math.ceil(s)) - at(math.floor(s))) * F.lit(s - math.floor(s))).alias(f"q{i}")
            for i, s in enumerate(spots)
        ]
    )


def is_regular(times: DataFrame, key: str = "time") -> DataFrame:
    """One row: n_times, off_grid, regular. `times` is a per-time table.

    n distinct times are evenly spaced exactly when each lies a whole number of mean steps
    after the first, so no ordering is needed. Two or fewer times are regular.
    """
    numeric = _is_numeric(times, key)
    distinct = times.select(key).where(F.col(key).isNotNull()).distinct()
    bounds = distinct.agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count(key).alias("n"))
    whole = bounds.select(F.struct("first", "last", "n")).scalar()
    first, last, count = F.col("whole.first"), F.col("whole.last"), F.col("whole.n")
    if numeric:
        steps = F.try_divide((F.col(key) - first) * (count - 1), last - first)
        off = F.abs(steps - F.round(steps)) > 1e-9
    else:
        span = F.timestamp_diff("MICROSECOND", first, last)
        step = F.floor(F.try_divide(span, count - 1))
        off = (F.try_mod(span, count - 1) != 0) | (
            F.try_mod(F.timestamp_diff("MICROSECOND", first, F.col(key)), step) != 0
        )
    judged = F.when(count > 2, off).otherwise(F.lit(False))
    return (
        distinct.withColumn("whole", whole)
        .agg(F.count(key).alias("n_times"), F.coalesce(F.count_if(judged), F.lit(0)).alias("off_grid"))
        .withColumn("regular", F.col("off_grid") == 0)
    )
