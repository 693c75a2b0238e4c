"""Bring raw tables to the canonical schema: time, level (Pa), lat, lon and field names."""

from __future__ import annotations

import calendar
import datetime as dt
import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermobox.functions.columns import nan_to_null, wrap_longitude
from thermobox.sources.state import UPPER_KEYS
from thermobox.specs import KELVIN_OFFSET

# Names and units the sources use.
COORDINATE_NAMES = {
    "valid_time": "time",
    "latitude": "lat",
    "longitude": "lon",
    "pressure_level": "level",
    "isobaricInhPa": "level",
}
MERGED_NAMES = {
    "temperature": "T",
    "u_component_of_wind": "u",
    "v_component_of_wind": "v",
    "vertical_velocity": "w",
    "surface_pressure": "sp",
    "2m_temperature": "T2m",
    "10m_u_component_of_wind": "u10",
    "10m_v_component_of_wind": "v10",
}
AUXILIARY = ("number", "expver", "step", "surface")
HECTOPASCAL_UNITS = ("hpa", "hectopascal", "hectopascals", "millibar", "mbar")
HECTOPASCAL_BELOW = 2000.0
CELSIUS_UNITS = ("C", "celsius", "Celsius")
KELVIN_UNITS = ("K", "kelvin", "Kelvin")
TEMPERATURES = ("T", "T2m")


def unit_of(df: DataFrame, name: str) -> str | None:
    """Unit kept in the metadata of a column."""
    return df.schema[name].metadata.get("units")


def with_unit(df: DataFrame, name: str, unit: str, column: Column | None = None) -> DataFrame:
    """Set the unit of a column, optionally with a new expression for it."""
    column = F.col(name) if column is None else column
    return df.withColumn(name, column.alias(name, metadata={"units": unit}))


def rename_coordinates(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({old: new for old, new in COORDINATE_NAMES.items() if old in df.columns})


def drop_auxiliary(df: DataFrame) -> DataFrame:
    return df.drop(*AUXILIARY)


def require_columns(df: DataFrame, names: Iterable[str], what: str) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing {what}: {missing}")


def to_kelvin(df: DataFrame, name: str, strict: bool = False) -> DataFrame:
    """Celsius to Kelvin by the unit of the column. Strict: the unit must be known."""
    unit = unit_of(df, name)
    if unit in CELSIUS_UNITS:
        return with_unit(df, name, "K", F.col(name) + F.lit(KELVIN_OFFSET))
    if strict and unit is None:
        raise ValueError(f"temperature {name} has no unit")
    if strict and unit not in KELVIN_UNITS:
        raise ValueError(f"unexpected temperature unit of {name}: {unit}")
    return with_unit(df, name, "K")


def largest_coordinates(tables: Iterable[DataFrame]) -> dict[str, float | None]:
    """Largest level and longitude over tables with canonical names: one scan of those columns."""
    parts = [
        df.select(*[
            (F.col(n) if n in df.columns else F.lit(None)).cast("double").alias(n) for n in ("level", "lon")
        ])
        for df in tables
    ]
    return reduce(DataFrame.unionByName, parts).agg(F.max("level").alias("level"), F.max("lon").alias("lon")).first().asDict()


def harmonise(df: DataFrame, largest: dict[str, float] | None = None) -> DataFrame:
    """Rename, drop helpers, convert units, wrap longitudes, turn NaN into NULL.

    Whether levels are in hPa and longitudes in 0..360 depends on the largest value. That is
    one scan of the two columns, skipped when `largest` gives the values.
    """
    df = drop_auxiliary(rename_coordinates(df))
    require_columns(df, ("time", "lat", "lon"), "coordinates")
    has_level = "level" in df.columns
    unit = (unit_of(df, "level") or "").strip().lower() if has_level else ""
    in_hectopascal = unit in HECTOPASCAL_UNITS
    top = largest if largest is not None else largest_coordinates([df])
    if has_level and not in_hectopascal:
        in_hectopascal = top["level"] is not None and top["level"] < HECTOPASCAL_BELOW

    lon = F.col("lon").cast("double")
    columns = {"lat": F.col("lat").cast("double")}
    columns["lon"] = wrap_longitude(lon) if top["lon"] is not None and top["lon"] > 180 else lon
    if has_level:
        level = F.col("level").cast("double")
        columns["level"] = level * F.lit(100.0) if in_hectopascal else level
    for entry in df.schema:
        if entry.name not in UPPER_KEYS and isinstance(entry.dataType, T.FractionalType):
            columns[entry.name] = nan_to_null(F.col(entry.name).cast("double")).alias(
                entry.name, metadata=entry.metadata
            )
    df = df.withColumns(columns)
    if has_level:
        df = with_unit(df, "level", "Pa")
    for name in TEMPERATURES:
        if name in df.columns:
            df = to_kelvin(df, name)
    return df


_PARTS = re.compile(
    r"^(\d{4})(?:-(\d{2})(?:-(\d{2})(?:[T ](\d{2})(?::(\d{2})(?::(\d{2})(\.\d+)?)?)?)?)?)?$"
)


def _period(text: str) -> tuple[dt.datetime, dt.datetime]:
    """First instant of the period a partial date names, and the first instant after it."""
    match = _PARTS.match(text.strip())
    if match is None:
        raise ValueError(f"not a date: {text}")
    year, month, day, hour, minute, second = (int(p) if p else None for p in match.groups()[:6])
    start = dt.datetime(year, month or 1, day or 1, hour or 0, minute or 0, second or 0)
    if match.group(7):
        start += dt.timedelta(seconds=float("0" + match.group(7)))
        return start, start + dt.timedelta(microseconds=1)
    if month is None:
        return start, start.replace(year=year + 1)
    if day is None:
        return start, start + dt.timedelta(days=calendar.monthrange(year, month)[1])
    unit = "days" if hour is None else "hours" if minute is None else "minutes" if second is None else "seconds"
    return start, start + dt.timedelta(**{unit: 1})


def slice_time(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Keep start <= time <= end; a partial end date includes the whole period it names.

    The bounds are literals of the type of the column, so they reach the scan. A stored
    state also has its `date` folders cut, or its folders by month, which begin on `since`.
    """
    kind = df.schema["time"].dataType
    folder = "since" if "since" in df.columns else "date"
    by_date = folder in df.columns and isinstance(df.schema[folder].dataType, T.DateType)
    by_month = folder == "since" or "day" in df.columns  # of cells read as they lie `date` is the first day of the folder
    condition = F.lit(True)
    if start is not None:
        first = _period(start)[0]
        condition = condition & (F.col("time") >= F.lit(first.isoformat(sep=" ")).cast(kind))
        if by_date:
            condition = condition & (F.col(folder) >= F.lit(first.date().replace(day=1) if by_month else first.date()))
    if end is not None:
        after = _period(end)[1]
        condition = condition & (F.col("time") < F.lit(after.isoformat(sep=" ")).cast(kind))
        if by_date:
            condition = condition & (F.col(folder) <= F.lit(after.date()))
    return df.where(condition)
