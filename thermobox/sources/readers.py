"""Read raw Parquet tables in either layout and return a canonical GridState."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermobox.functions.columns import nan_to_null
from thermobox.operators.axes import coordinate_axes
from thermobox.sources.harmonise import (
    COORDINATE_NAMES,
    MERGED_NAMES,
    drop_auxiliary,
    harmonise,
    largest_coordinates,
    rename_coordinates,
    require_columns,
    slice_time,
    to_kelvin,
    with_unit,
)
from thermobox.sources.state import (
    NEAR_SURFACE_FIELDS,
    SURFACE_FIELDS,
    SURFACE_KEYS,
    UPPER_FIELDS,
    UPPER_KEYS,
    GridState,
)
from thermobox.specs import SourceSpec, SurfacePolicy

# File stem and raw column of each variable in the per-variable layout.
VARIABLE_FILES = {
    "T": ("T", "t"),
    "u": ("ux", "u"),
    "v": ("uy", "v"),
    "w": ("uz", "w"),
    "sp": ("sfp", "sp"),
    "T2m": ("surface_temperature", "t2m"),
    "u10": ("surface_ux", "u10"),
    "v10": ("surface_uy", "v10"),
}


def wanted_fields(policy: SurfacePolicy) -> tuple[str, ...]:
    optional = NEAR_SURFACE_FIELDS if policy.use_surface_fields else ()
    return (*UPPER_FIELDS, *SURFACE_FIELDS, *optional)


def load_state(
    spark: SparkSession,
    source: SourceSpec,
    policy: SurfacePolicy = SurfacePolicy(),
    largest: Mapping[str, float] | None = None,
    coordinates: bool = False,
) -> GridState:
    """Read, harmonise and slice the source.

    `largest` gives the largest raw `level` and `lon` where known, and saves a scan of them. With `coordinates` the state
    has its axes, of single variables taken from their keys before they are merged; for a state that is stored as it is.
    """
    if source.kind == "merged":
        state = _load_merged(spark, source, policy, largest)
        return replace(state, axes=coordinate_axes(state.upper)) if coordinates else state
    if source.kind == "per_variable":
        return _load_per_variable(spark, source, policy, largest, coordinates)
    raise ValueError(f"unsupported source kind: {source.kind}")


def _load_merged(spark, source: SourceSpec, policy: SurfacePolicy, largest) -> GridState:
    """One table whose 4-D rows carry the surface fields too."""
    # Sliced before the columns are chosen, so that a `date` folder of the source is cut as well.
    raw = slice_time(rename_coordinates(spark.read.parquet(source.path)), source.time_start, source.time_end)
    fields = wanted_fields(policy)
    long_names = {new: old for old, new in MERGED_NAMES.items()}
    require_same(raw, {name: long_names[name] for name in fields if {name, long_names[name]} <= set(raw.columns)})
    picked = {name: long_names[name] if long_names[name] in raw.columns else name for name in fields}
    require_columns(raw, picked.values(), "variables")
    keys = [c for c in raw.columns if COORDINATE_NAMES.get(c, c) in UPPER_KEYS]
    table = raw.select(*keys, *[F.col(old).alias(new, metadata=raw.schema[old].metadata) for new, old in picked.items()])
    table = harmonise(with_units(table, source.units), largest)
    require_columns(table, UPPER_KEYS, "coordinates")
    return GridState(table.select(*UPPER_KEYS, *fields))


def require_same(raw: DataFrame, twice: Mapping[str, str]) -> None:
    """Variables that a source gives under two names must agree in every row."""
    if not twice:
        return
    differ = [
        F.count_if(~nan_to_null(F.col(a).cast("double")).eqNullSafe(nan_to_null(F.col(b).cast("double")))).alias(a)
        for a, b in twice.items()
    ]
    wrong = [name for name, n in raw.agg(*differ).first().asDict().items() if n]
    if wrong:
        raise ValueError(f"sources disagree on {', '.join(wrong)}")


def with_units(df: DataFrame, units: Mapping[str, str]) -> DataFrame:
    """Units stated by the caller, for the columns that are there."""
    for name, unit in units.items():
        if name in df.columns:
            df = with_unit(df, name, unit)
    return df


def read_variable(spark: SparkSession, path: str, name: str, units: Mapping[str, str] = {}) -> DataFrame:
    """One variable under its canonical name; temperatures must have a unit, stated by the table or in `units`."""
    stem, raw_name = VARIABLE_FILES[name]
    df = drop_auxiliary(rename_coordinates(spark.read.parquet(f"{path}/{stem}.parquet")))
    df = with_units(df.withColumnRenamed(raw_name, name), units)
    return to_kelvin(df, name, strict=True) if name in ("T", "T2m") else df


def _load_per_variable(spark, source: SourceSpec, policy: SurfacePolicy, largest, coordinates: bool) -> GridState:
    tables = {
        name: slice_time(read_variable(spark, source.path, name, source.units), source.time_start, source.time_end)
        for name in wanted_fields(policy)
    }
    upper = merge_tables({n: t for n, t in tables.items() if n in UPPER_FIELDS}, UPPER_KEYS)
    surface = merge_tables({n: t for n, t in tables.items() if n not in UPPER_FIELDS}, SURFACE_KEYS)
    # Taken before the merge, so that finding it shuffles nothing.
    largest = largest_coordinates(tables.values()) if largest is None else largest
    axes = None
    if coordinates:  # every point of any table is a point of the merge, under the units of the merge
        points = reduce(DataFrame.unionByName, [t.select(*UPPER_KEYS) for n, t in tables.items() if n in UPPER_FIELDS])
        points = points.select(*[F.col(k).alias(k, metadata=upper.schema[k].metadata) for k in UPPER_KEYS])
        axes = coordinate_axes(harmonise(points, largest))
    return GridState(harmonise(upper, largest), harmonise(surface, largest), axes=axes)


def merge_tables(tables: Mapping[str, DataFrame], keys: tuple[str, ...]) -> DataFrame:
    """Put variables side by side on their coordinates; a point in any table is kept.

    Each table is widened to all variables and the union is grouped once by the keys, so
    n tables cost one shuffle instead of n - 1 joins. Rows of a key are few (one per
    table), and partial aggregation folds them early. A second value of a variable at a key stops the job.
    """
    return merge_sources({name: df.select(*keys, name) for name, df in tables.items()}, keys)


def merge_sources(sources: Mapping[str, DataFrame], keys: tuple[str, ...]) -> DataFrame:
    """The variables of all sources side by side, as `merge_tables` does for one variable each.

    A variable that several sources hold must be the same in all of them, at every point, missing values included; the
    first disagreement stops the job and names the variable. `merge_clashes` lists them.
    """
    merged, holders = _combined(sources, keys)
    units: dict[str, dict] = {}
    for df in sources.values():
        for name in df.columns:
            units.setdefault(name, df.schema[name].metadata)

    def agreed(name: str) -> Column:
        wrong = F.raise_error(F.concat(F.lit(f"sources disagree on {name}, or give two values, at "), F.to_json(F.struct(*keys)))).cast("double")
        return F.when(_clash(name, len(holders[name])), wrong).otherwise(F.col(f"{name}.low"))

    return merged.select(*[F.col(k).alias(k, metadata=units[k]) for k in keys], *[agreed(n).alias(n, metadata=units[n]) for n in holders])


def merge_clashes(sources: Mapping[str, DataFrame], keys: tuple[str, ...]) -> DataFrame:
    """keys, variable, low, high, holders: where sources do not agree on a variable.

    `low` and `high` are the smallest and largest value given, `holders` the sources that give one, comma-joined.
    """
    merged, holders = _combined(sources, keys)
    found = []
    for name, of in holders.items():
        given = F.array_compact(F.array(*[F.when(F.col(f"{name}.mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(list(sources)[i])) for i in of]))
        row = F.struct(F.lit(name).alias("variable"), F.col(f"{name}.low").alias("low"), F.col(f"{name}.high").alias("high"),
                       F.array_join(given, ",").alias("holders"))
        found.append(F.when(_clash(name, len(of)), row))
    return merged.select(*keys, F.inline(F.array_compact(F.array(*found))))


def _combined(sources: Mapping[str, DataFrame], keys: tuple[str, ...]) -> tuple[DataFrame, dict[str, list[int]]]:
    """One row per key with, by variable, the smallest and largest value, their number and the set of sources that gave one.

    Also which sources hold each variable. All that decides about agreement goes through one shuffle, folded before it.
    """
    holders: dict[str, list[int]] = {}
    for number, df in enumerate(sources.values()):
        for name in df.columns:
            if name not in keys:
                holders.setdefault(name, []).append(number)
    union = None
    for number, df in enumerate(sources.values()):
        values = [nan_to_null(F.col(n).cast("double")) if number in of else F.lit(None).cast("double") for n, of in holders.items()]
        part = df.select(*keys, *[v.alias(n) for v, n in zip(values, holders)], F.lit(1 << number).alias("_source"))
        union = part if union is None else union.unionByName(part)
    sums = [
        F.struct(
            F.min(name).alias("low"), F.max(name).alias("high"), F.count(name).alias("n"),
            F.coalesce(F.bit_or(F.when(F.col(name).isNotNull(), F.col("_source"))), F.lit(0)).alias("mask"),
        ).alias(name)
        for name in holders
    ]
    return union.groupBy(*keys).agg(*sums), holders


def _clash(name: str, holders: int) -> Column:
    """Different values, a value that not all holders give, or one that a source gives twice."""
    n = F.col(f"{name}.n")
    return (F.col(f"{name}.low") != F.col(f"{name}.high")) | ((n > 0) & (n != holders)) | (n != F.bit_count(f"{name}.mask"))
