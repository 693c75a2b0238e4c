"""Write the canonical state and budget tables so that later runs read little and join nothing."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermobox.operators.axes import Tiling, coordinate_axes, rows_per_hour, tile_starts
from thermobox.session import materialise, stored as written_rows
from thermobox.sources.quality import cells_per_time, read_axes
from thermobox.sources.state import UPPER_FIELDS, UPPER_KEYS, GridState

#: Latitudes and longitudes of a tile, and the most tiles along an axis: a longer axis has larger tiles.
TILE_POINTS, MOST_TILES = 36, 256
#: A tile that has at most so many rows in a month of hours gets a folder a month instead of a day.
MONTH_ROWS, MONTH_HOURS = 1 << 20, 744


def write_state(
    state: GridState, path: str, surface_fields: tuple[str, ...] = ("sp",), append: bool = False, tile_points: int = TILE_POINTS
) -> None:
    """One wide table in folders by date and tile, rows sorted by place, then time, then level.

    The one join of ground and upper air happens here; budgets on the result need none. A box reads the folders of its
    tiles only, a wall those of its rows and columns. Sorted latitudes and longitudes give row groups narrow
    ranges as well, and a ground value repeated over the levels packs into runs.

    Folders are by day where the grid is large. Of a small one a day is a few thousand rows, and a long series would spend
    its time on making, listing and opening files, so that folders are by month there; the coordinates of the first write decide.

    Rows are dealt by date and tile without sampling; the number of tasks follows from the size of the data, as small
    shares are put together and large ones cut at run time. `append` adds days, or replaces the tiles of
    days that `state` holds, and leaves the others as they are; the tiles are those of the first write. With folders by month
    the rows are stored first, and the other days of their folders are read and written again with them.

    Rows and distinct cells of each hour are counted from the keys of the days just written and kept per hour, so that the
    quality report of a stored state reads no cell.
    """
    spark = state.upper.sparkSession
    tiling = read_tiling(spark, path) if append else None
    joined = tiling is not None and tiling.monthly
    if joined:
        state = GridState(written_rows(state.rows(UPPER_FIELDS, surface_fields), "added"), axes=state.axes)
    axes = materialise(coordinate_axes(state.upper) if state.axes is None else state.axes)
    if tiling is None:
        monthly = rows_per_hour(axes, tile_points, MOST_TILES) * MONTH_HOURS <= MONTH_ROWS
        starts = tile_starts(axes, tile_points, MOST_TILES).withColumn("monthly", F.lit(monthly))
        starts.coalesce(1).write.mode("overwrite").parquet(f"{path}/tiles")
        tiling = read_tiling(spark, path) or Tiling((), ())
    keys = ("date", "tile_lat", "tile_lon")
    rows = state.rows(UPPER_FIELDS, surface_fields).withColumns(tiling.folders())
    day = "day" if tiling.monthly else "date"
    written = Observation("written")
    given = rows.observe(written, F.min(day).alias("first"), F.max(day).alias("last"))
    (
        (given.unionByName(_other_days(rows, f"{path}/cells", keys)) if joined else given).hint("rebalance", *keys)
        .sortWithinPartitions(*keys, "lat", "lon", "time", "level")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if append else "static")
        .partitionBy(*keys)
        .parquet(f"{path}/cells")
    )
    axes.coalesce(1).write.mode("append" if append else "overwrite").parquet(f"{path}/axes")
    try:
        first, last = (written.get[name] for name in ("first", "last"))
    except Py4JJavaError:  # of a period without rows Spark drops the observation with the rest of the plan
        first = last = None
    first, last = (F.lit(bound).cast("date") for bound in (first, last))
    days = F.col(day).between(first, last)
    if tiling.monthly:
        days = days & F.col("date").between(F.trunc(first, "month"), last)
    stored = GridState(spark.read.schema(rows.schema).parquet(f"{path}/cells").where(days), axes=_read_axes(spark, path))
    write_hours(cells_per_time(stored.upper, read_axes(stored), UPPER_KEYS[1:]), f"{path}/summary", append)


def _other_days(rows: DataFrame, path: str, keys: tuple[str, ...]) -> DataFrame:
    """The stored cells of the monthly folders that `rows` go into, without the days that `rows` give anew there."""
    given = written_rows(rows.groupBy(*keys).agg(F.collect_set("day").alias("given")), "folders")  # one row a folder, 31 days at most
    first, last = given.agg(F.min("date"), F.max("date")).first()
    held = rows.sparkSession.read.schema(rows.schema).parquet(path)
    held = held.where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return held.join(given, list(keys)).where(~F.array_contains("given", F.col("day"))).drop("given")


def write_hours(hours: DataFrame, path: str, append: bool = False) -> None:
    """A per-hour table by year, one file of some thousand rows each. With `append` the days of `hours` replace the stored ones.

    Folders by day would hold 24 rows, so that a long series spent its time on opening and listing files. The years that get
    days are read and written again with what they hold of other days, so `hours` is stored first: it is needed three times.
    """
    days = {"year": F.year("time"), "date": F.to_date("time")}
    new = written_rows(hours, "hours") if append else hours
    rows = new.withColumns(days)
    held = read_hours(hours.sparkSession, path, new.schema) if append else None
    if held is not None:
        years = [r["year"] for r in rows.select("year").distinct().collect()]
        year = F.col("year").isin(*[y for y in years if y is not None])
        own = F.broadcast(rows.select(F.col("date").alias("day")).distinct())
        held = held.where(year | F.col("year").isNull() if None in years else year).withColumn("date", F.to_date("time"))
        rows = rows.unionByName(held.join(own, F.col("date").eqNullSafe(F.col("day")), "left_anti"))
    (
        rows.drop("date").hint("rebalance", "year").sortWithinPartitions("year", "time")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if append else "static")
        .partitionBy("year").parquet(path)
    )


def read_hours(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The rows of write_hours with their `year`; None where nothing has been written."""
    try:
        return spark.read.schema(T.StructType([*schema, T.StructField("year", T.IntegerType())])).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_tiling(spark: SparkSession, path: str) -> Tiling | None:
    """The tiles of a written state, at most 2 x MOST_TILES numbers; None where no row has been written."""
    try:
        rows = spark.read.schema("axis string, tile int, start double, monthly boolean").parquet(f"{path}/tiles").orderBy("start").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if not rows:
        return None
    lat, lon = (tuple(r["start"] for r in rows if r["axis"] == axis) for axis in ("lat", "lon"))
    return Tiling(lat, lon, any(r["monthly"] for r in rows))  # stores of earlier versions do not say it


def read_state(spark: SparkSession, path: str) -> GridState:
    """A table made by write_state, with its coordinates and tiles. Filters on `date` and tiles prune folders.

    `date` is the day of a row. With folders by month `since` is the first day of its folder, and filters on that prune.
    """
    cells = spark.read.parquet(f"{path}/cells")
    if "day" in cells.columns:
        cells = cells.withColumnsRenamed({"date": "since", "day": "date"})
    counts = T.StructType([cells.schema["time"], *(T.StructField(n, T.LongType()) for n in ("n_rows", "n_cells"))])
    summary = read_hours(spark, f"{path}/summary", counts)
    return GridState(cells, axes=_read_axes(spark, path), tiling=read_tiling(spark, path), summary=None if summary is None else summary.drop("year"))


def _read_axes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("axis string, value double").parquet(f"{path}/axes").distinct()


def write_budget(table: DataFrame, path: str) -> None:
    """A per-time result table by date."""
    (
        table.withColumn("date", F.to_date("time"))
        .repartitionByRange("date")
        .sortWithinPartitions("time")
        .write.mode("overwrite")
        .partitionBy("date")
        .parquet(path)
    )
