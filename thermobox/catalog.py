"""Every operator as a query over the driver's tables: name -> (spark, sf_dir) -> DataFrame.

Values are scaled to K/h, 1/h, 1e9 m2 or 1e15 m2 Pa and rounded, so that sums taken in
another order compare equal.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermobox.functions.columns import open_face
from thermobox.operators.axes import coordinate_axes, measure_axes
from thermobox.operators.domain import (
    Box,
    cell_volumes,
    halo_cells,
    horizontal_areas,
    refusals,
    resolve_box,
    wall_areas,
)
from thermobox.operators.series import centered_difference, daily, index_by, is_regular, rolling_mean, running_sum
from thermobox.operators.volume import area_integral, domain_cells, domain_volume, heating_rate, volume_integral
from thermobox.operators.walls import blended_state, surface_cases, surface_shares, wall_faces
from thermobox.operators.weights import horizontal_weights, volume_weights, wall_weights
from thermobox.plans import diagnostics
from thermobox.plans.budget import BudgetRun, run_budget, temperature_spread
from thermobox.plans.incremental import read_run, write_moments
from thermobox.plans.many import run_budgets
from thermobox.plans.run import run_source
from thermobox.session import fresh_folder
from thermobox.sources.events_grid import events_state, gridded_events
from thermobox.sources.harmonise import MERGED_NAMES, harmonise, slice_time, with_unit
from thermobox.sources.layout import read_state, write_budget, write_state
from thermobox.sources.quality import quality_report
from thermobox.sources.readers import VARIABLE_FILES, load_state, merge_clashes, merge_sources, merge_tables
from thermobox.sources.state import NEAR_SURFACE_FIELDS, SURFACE_FIELDS, SURFACE_KEYS, UPPER_FIELDS, UPPER_KEYS, GridState, fill_holes
from thermobox.specs import BoxRequest, SourceSpec, SurfacePolicy

Query = Callable[[SparkSession, str], DataFrame]

GROUND = BoxRequest()
LEVEL = BoxRequest(bottom_pressure=90000.0)
OVERFLOW = SurfacePolicy()
CLIPPED = SurfacePolicy(allow_overflow=False)
BLENDED = SurfacePolicy(surface_mode="combined")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double; adding 0.0 turns -0.0 into 0.0."""
    return df.select(*[
        (F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else f.name
        for f in df.schema
    ])


def _hourly_rate(name: str, volume: str = "domain_volume") -> Column:
    return diagnostics.per_hour(F.col(name), F.col(volume)).alias(name)


def _state(spark: SparkSession, sf_dir: str) -> GridState:
    return events_state(spark, sf_dir)


def _boxed(spark: SparkSession, sf_dir: str, request: BoxRequest = GROUND) -> tuple[GridState, Box]:
    state = _state(spark, sf_dir)
    return state, resolve_box(state, request)


def _run(spark: SparkSession, sf_dir: str, request: BoxRequest = GROUND, policy: SurfacePolicy = OVERFLOW) -> BudgetRun:
    return run_budget(_state(spark, sf_dir), request, policy)


# Grid and geometry


def cell_edges(spark, sf_dir):
    axes = measure_axes(coordinate_axes(_state(spark, sf_dir).upper))
    return axes.where(F.col("axis") == "level").select(
        F.col("value").alias("level"), F.col("id").alias("level_id"),
        F.col("lower_edge").alias("p_start"), F.col("upper_edge").alias("p_end"))


def bbox_cells(spark, sf_dir):
    request = BoxRequest(bbox=(43.0, 57.0, -124.0, -112.0))
    axes = measure_axes(coordinate_axes(_state(spark, sf_dir).upper), request)
    return axes.where((F.col("axis") != "level") & F.col("covered")).select(
        "axis", F.col("id").alias("cell_id"), F.col("lower_edge").alias("cell_start"), F.col("upper_edge").alias("cell_end"))


def halo_flags(spark, sf_dir):
    _, box = _boxed(spark, sf_dir)
    return halo_cells(box).select("lat_id", "lon_id", "lat_start", "lat_end", "lon_start", "lon_end", "in_domain")


def horizontal_area(spark, sf_dir):
    _, box = _boxed(spark, sf_dir)
    return rounded(horizontal_areas(box).select("lat_id", "lon_id", (F.col("area") / 1e9).alias("area")))


def wall_area(spark, sf_dir):
    _, box = _boxed(spark, sf_dir)
    return rounded(wall_areas(box).withColumn("area", F.col("area") / 1e9))


def cell_volume(spark, sf_dir):
    _, box = _boxed(spark, sf_dir)
    return rounded(cell_volumes(box).withColumn("volume", F.col("volume") / 1e15))


# Sources


def raw_table(spark, sf_dir) -> DataFrame:
    """The grid under external names: hPa levels, 0..360 longitudes, Celsius, helper columns."""
    points = gridded_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    raw = points.select(
        F.col("time").alias("valid_time"), (F.col("level") / 100).alias("pressure_level"),
        F.col("lat").alias("latitude"), (F.col("lon") + 360).alias("longitude"),
        F.lit(0).alias("number"), F.lit("0001").alias("expver"),
        (F.col("T") - F.lit(273.15)).alias("T"), "u", "v", "w",
    )
    return with_unit(raw, "T", "C")


def harmonised(spark, sf_dir):
    return rounded(harmonise(raw_table(spark, sf_dir)).select(*UPPER_KEYS, *UPPER_FIELDS), 10)


def merge_variables(spark, sf_dir):
    """All variables side by side; each table lacks other points, and a point in any table is kept."""
    upper = _state(spark, sf_dir).upper
    lacking = {"T": "level >= 80000", "u": "level <= 90000", "v": "lat > 45", "w": "lon < -112"}
    tables = {name: upper.where(rule).select(*UPPER_KEYS, name) for name, rule in lacking.items()}
    return rounded(merge_tables(tables, UPPER_KEYS), 10)


def _twins(spark, sf_dir) -> dict[str, DataFrame]:
    """Three sources over the same points, two of which hold T and two w."""
    points = gridded_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    held = {"first": ("T", "u"), "second": ("T", "v", "w"), "third": ("w", "event_id")}
    return {name: points.select(*UPPER_KEYS, *names) for name, names in held.items()}


def merge_twins(spark, sf_dir):
    """Sources that hold the same variables in full agreement, side by side."""
    return rounded(merge_sources(_twins(spark, sf_dir), UPPER_KEYS).drop("event_id"), 10)


def merge_conflicts(spark, sf_dir):
    """Where they disagree: values that differ, are missing on one side, or stand twice."""
    sources = _twins(spark, sf_dir)
    number = F.col("event_id")
    changed = sources["third"].withColumn("w", F.when(number % 97 == 5, F.col("w") + 1).when(number % 89 != 3, F.col("w")))
    changed = changed.where(number % 101 != 7)
    again = sources["first"].join(sources["third"].where(number % 211 == 9).select(*UPPER_KEYS), list(UPPER_KEYS))
    sources |= {"first": sources["first"].unionByName(again), "third": changed.drop("event_id")}
    return rounded(merge_clashes(sources, UPPER_KEYS), 10)


def time_slice(spark, sf_dir):
    upper = _state(spark, sf_dir).upper.select(*UPPER_KEYS, "T")
    return rounded(slice_time(upper, "2024-01-02T00:00:00", "2024-01-03"), 10)


def quality(spark, sf_dir):
    points = with_unit(gridded_events(spark.read.parquet(f"{sf_dir}/events.parquet")), "T", "K")
    return quality_report(GridState(points, _state(spark, sf_dir).surface), order="event_id")


def quality_stored(spark, sf_dir):
    """The report of a state written in two parts, from the counts kept with it."""
    folder = fresh_folder(spark, "state")
    points = with_unit(gridded_events(spark.read.parquet(f"{sf_dir}/events.parquet")), "T", "K").select(*UPPER_KEYS, *UPPER_FIELDS)
    state = GridState(points, _state(spark, sf_dir).surface)
    split = F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")
    write_state(state.restrict(F.col("time") < split), folder)
    write_state(state.restrict(F.col("time") >= split), folder, append=True)
    return quality_report(read_state(spark, folder))


def event_hours(spark, sf_dir) -> DataFrame:
    """Mean of `value` per clock hour."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    hour = F.expr("CAST(to_date(ts) AS timestamp_ntz) + make_dt_interval(0, hour(ts), 0, 0)")
    return events.groupBy(hour.alias("time")).agg(F.avg("value").alias("value"))


def time_regularity(spark, sf_dir):
    return is_regular(event_hours(spark, sf_dir)).select("n_times", "regular")


# Weights


def top_bottom_weight(spark, sf_dir):
    return horizontal_weights(*_boxed(spark, sf_dir, LEVEL))


def _wall_weight(request: BoxRequest, policy: SurfacePolicy) -> Query:
    return lambda spark, sf_dir: rounded(wall_weights(*_boxed(spark, sf_dir, request), policy), 9)


def _volume_weight(request: BoxRequest, policy: SurfacePolicy) -> Query:
    return lambda spark, sf_dir: rounded(volume_weights(*_boxed(spark, sf_dir, request), policy), 9)


# Volume


def volume(spark, sf_dir):
    state, box = _boxed(spark, sf_dir)
    return rounded(domain_volume(state, box, OVERFLOW).withColumn("volume", F.col("volume") / 1e15))


def domain_mean_t(spark, sf_dir):
    state, box = _boxed(spark, sf_dir)
    sums = volume_integral(domain_cells(state, box, OVERFLOW, ("T",)), volume=F.lit(1.0), heat=F.col("T"))
    return rounded(sums.select("time", F.try_divide("heat", "volume").alias("T_domain_avg")))


def adiabatic(spark, sf_dir):
    state, box = _boxed(spark, sf_dir)
    sums = volume_integral(
        domain_cells(state, box, OVERFLOW), volume=F.lit(1.0), adiabatic_heating=heating_rate())
    return rounded(sums.select("time", _hourly_rate("adiabatic_heating", "volume")))


def heat_storage(spark, sf_dir):
    state, box = _boxed(spark, sf_dir)
    sums = volume_integral(domain_cells(state, box, OVERFLOW, ("T",)), volume=F.lit(1.0), heat=F.col("T"))
    rates = centered_difference(index_by(sums), {"d_dt_T": "heat"}).frame
    return rounded(rates.select("time", _hourly_rate("d_dt_T", "volume")))


# Series


def centered_diff(spark, sf_dir):
    rates = centered_difference(index_by(event_hours(spark, sf_dir)), {"dvalue_dt": "value"}).frame
    return rounded(rates.select("time", (F.col("dvalue_dt") * 3600).alias("dvalue_dt")), 9)


def rolling_24h(spark, sf_dir):
    return rounded(rolling_mean(index_by(event_hours(spark, sf_dir)), ["value"], 24).frame.select("time", "value"), 9)


def running_integral(spark, sf_dir):
    series = running_sum(index_by(event_hours(spark, sf_dir)), {"integral": F.col("value") * 3600})
    return rounded(series.frame.select("time", (F.col("integral") / 1e6).alias("integral")), 9)


def daily_rollup(spark, sf_dir):
    hours = event_hours(spark, sf_dir).withColumn("mean_value", F.col("value"))
    return rounded(daily(hours, ["mean_value"], {"total": F.col("value") * 2}), 9)


# Walls


def surface_mask(spark, sf_dir):
    state, box = _boxed(spark, sf_dir)
    case = F.col("case")
    return surface_cases(state, box, OVERFLOW).groupBy("time").agg(
        F.count_if(case == "A").alias("n_untouched"),
        F.count_if(case == "B").alias("n_below_middle"),
        F.count_if(case == "C").alias("n_above_middle"),
        F.count_if((F.col("level_id") == 0) & (F.col("sp") >= F.col("p_start"))).alias("n_overflow"),
    )


def surface_blend(spark, sf_dir):
    state, box = _boxed(spark, sf_dir)
    rows = blended_state(state, box, BLENDED)
    ids = box.attach(box.attach(rows, "lat", "lat_id"), "lon", "lon_id")
    # Ratios and knots never end on a half digit, where engines round apart.
    return rounded(ids.select(
        "time", "level_id", "lat_id", "lon_id", (F.col("T") / 273.15).alias("T_ratio"),
        *[(F.col(name) * 900 / 463).alias(f"{name}_knots") for name in ("u", "v")]), 10)


def surface_share(spark, sf_dir):
    state, box = _boxed(spark, sf_dir)
    return rounded(surface_shares(state, box, OVERFLOW))


def faces(spark, sf_dir):
    state, box = _boxed(spark, sf_dir)
    return rounded(wall_faces(state, box, OVERFLOW).select("time", "wall", "level_id", "along_id", "flow", "T"), 10)


def top_face(spark, sf_dir):
    state, box = _boxed(spark, sf_dir)
    rows = state.upper.where(box.domain_filter() & (F.col("level") == F.lit(box.spec.top_pressure)))
    ids = box.attach(box.attach(rows, "lat", "lat_id"), "lon", "lon_id")
    return rounded(ids.select("time", "lat_id", "lon_id", "w", "T"), 10)


def top_flux(spark, sf_dir):
    state, box = _boxed(spark, sf_dir)
    top = box.spec.top_pressure
    pieces = domain_cells(state, box, OVERFLOW).where(F.col("level") == top).withColumn("weight", open_face(F.col("sp"), top))
    sums = area_integral(pieces, mass=F.col("w"), heat=F.col("w") * F.col("T"))
    return rounded(sums.select("time", (F.col("mass") / 1e9).alias("mass"), (F.col("heat") / 1e12).alias("heat")))


def wall_flux(spark, sf_dir):
    run = _run(spark, sf_dir)
    names = {"flux_contribution": "heat", "mass_flux_contribution": "mass"}
    return rounded(run.series.frame.select("time", *[
        diagnostics.per_hour(F.col(f"{old}_{wall}"), F.col("domain_volume")).alias(f"{new}_{wall}")
        for old, new in names.items() for wall in run.spec.walls
    ]))


def _budget_rate(name: str) -> Query:
    return lambda spark, sf_dir: rounded(_run(spark, sf_dir).series.frame.select("time", _hourly_rate(name)))


def mass_residual_hourly(spark, sf_dir):
    return rounded(_run(spark, sf_dir).series.frame.select("time", "abs_mass_advection_residual_fraction"))


def t_scale(spark, sf_dir):
    return rounded(temperature_spread(_run(spark, sf_dir).moments.frame))


# Budget

RATES = ("d_dt_T", "dT_dt", "dT_dt_2", "dV_dt", "advection_term", "advection_error", "adiabatic_term", "diabatic_term")


def scaled(table: DataFrame) -> DataFrame:
    return rounded(table.select(
        "time", *[_hourly_rate(name) for name in RATES], "T_domain_avg",
        (F.col("domain_volume") / 1e15).alias("domain_volume"), "T_scale"))


def scaled_budget(run: BudgetRun) -> DataFrame:
    return scaled(run.table())


def _budget(request: BoxRequest, policy: SurfacePolicy) -> Query:
    return lambda spark, sf_dir: scaled_budget(_run(spark, sf_dir, request, policy))


def constant_t_budget(spark, sf_dir):
    return scaled_budget(_run(spark, sf_dir).constant_temperature())


# Summaries


def _summary(table: Callable[[BudgetRun], DataFrame], scale: Sequence[str] = (), by: float = 1.0, digits: int = 6) -> Query:
    def query(spark, sf_dir):
        df = table(_run(spark, sf_dir))
        return rounded(df.withColumns({name: F.col(name) / by for name in scale}), digits)

    return query


def quantile_residual(spark, sf_dir):
    binned = diagnostics.binned_residual(_run(spark, sf_dir), key=F.round(F.col("dV_dt") / 1e9, 6))
    return rounded(binned.withColumns({n: F.col(n) / 1e9 for n in ("mean_dV_dt", "mean_residual")}))


# Stored state, written results and raw layouts, below the shared folder


def _stored_run(spark, sf_dir, policy: SurfacePolicy, fields: tuple[str, ...]) -> BudgetRun:
    folder = fresh_folder(spark, "state")
    write_state(_state(spark, sf_dir), folder, fields)
    return run_budget(read_state(spark, folder), GROUND, policy)


def budget_stored(spark, sf_dir):
    return scaled_budget(_stored_run(spark, sf_dir, OVERFLOW, SURFACE_FIELDS))


def budget_stored_blended(spark, sf_dir):
    return scaled_budget(_stored_run(spark, sf_dir, BLENDED, (*SURFACE_FIELDS, *NEAR_SURFACE_FIELDS)))


def budget_appended(spark, sf_dir):
    """The later days are written first, the earlier ones appended."""
    folder, state = fresh_folder(spark, "state"), _state(spark, sf_dir)
    split = F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")
    write_state(state.restrict(F.col("time") >= split), folder)
    write_state(state.restrict(F.col("time") < split), folder, append=True)
    return scaled_budget(run_budget(read_state(spark, folder), GROUND))


def budget_gaps(spark, sf_dir):
    """A state with holes: single points are missing, and of some hours all points of the box."""
    points = gridded_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    number = F.col("event_id")
    upper = points.where((number % 13 != 4) & (F.expr("event_id DIV 100") % 17 != 6)).select(*UPPER_KEYS, *UPPER_FIELDS)
    filled = fill_holes(GridState(upper, _state(spark, sf_dir).surface), (*SURFACE_FIELDS, *NEAR_SURFACE_FIELDS))
    return scaled_budget(run_budget(filled, GROUND, BLENDED))


def budget_incremental(spark, sf_dir):
    """The sums of the first days are stored, those of the later days added, each from its own cells only."""
    folder, state = fresh_folder(spark, "moments"), _state(spark, sf_dir)
    split = F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")
    box = resolve_box(state, GROUND)
    write_moments(state.restrict(F.col("time") < split), box, OVERFLOW, folder)
    write_moments(state.restrict(F.col("time") >= split), box, OVERFLOW, folder, append=True)
    return scaled_budget(read_run(spark, folder))


#: Overlapping boxes, one with a lower lid and two with a bottom level.
MANY = {
    "whole": GROUND, "south": BoxRequest(bbox=(40.0, 55.0, -130.0, -110.0)),
    "north_west": BoxRequest(bbox=(45.0, 60.0, -130.0, -115.0), top_pressure=80000.0),
    "raised": LEVEL, "raised_east": BoxRequest(bbox=(40.0, 60.0, -125.0, -110.0), bottom_pressure=90000.0),
}


def budget_many(spark, sf_dir):
    """Five boxes in one run."""
    table = run_budgets(_state(spark, sf_dir), MANY)
    return rounded(table.select(
        "run", "time", *[_hourly_rate(name) for name in RATES], "T_domain_avg",
        (F.col("domain_volume") / 1e15).alias("domain_volume"), "T_scale"))


def budget_written(spark, sf_dir):
    folder = fresh_folder(spark, "budget")
    run = _run(spark, sf_dir)
    write_budget(run.table(), folder)
    return scaled(spark.read.parquet(folder))


def budget_checked(spark, sf_dir):
    """From raw tables to the budget in one call: load, store, validate, run."""
    folder = fresh_folder(spark, "raw")
    write_per_variable(spark, sf_dir, folder)
    source = SourceSpec("per_variable", folder, units={"T": "C", "T2m": "K"})
    run, _ = run_source(spark, source, GROUND, OVERFLOW, fresh_folder(spark, "state"))
    return scaled_budget(run)


def write_per_variable(spark, sf_dir, folder: str) -> None:
    """One table per variable under the names of that layout, without units."""
    points = gridded_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    keys = [F.col("time").alias("valid_time"), (F.col("lon") + 360).alias("longitude"), F.col("lat").alias("latitude")]
    for name, (stem, raw) in VARIABLE_FILES.items():
        upper = name in UPPER_FIELDS
        value = F.col(name) - F.lit(273.15) if name == "T" else F.col(name)
        rows = points if upper else points.where("layer = 0")
        levels = [(F.col("level") / 100).alias("pressure_level")] if upper else []
        rows.select(*keys, *levels, F.lit(1).alias("number"), value.alias(raw)).write.parquet(f"{folder}/{stem}.parquet")


def load_merged(spark, sf_dir):
    """The merged layout by date under long names, loaded for a part of the time with the near-surface fields."""
    points = gridded_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    names = {new: old for old, new in MERGED_NAMES.items()}
    fields = (*UPPER_FIELDS, *SURFACE_FIELDS, *NEAR_SURFACE_FIELDS)
    ground = points.where("layer = 0").select(*SURFACE_KEYS, *SURFACE_FIELDS, *NEAR_SURFACE_FIELDS)
    raw = points.select(*UPPER_KEYS, *UPPER_FIELDS).join(ground, list(SURFACE_KEYS)).withColumn("date", F.to_date("time"))
    raw = raw.withColumnsRenamed({**{n: names[n] for n in fields}, "time": "valid_time", "level": "isobaricInhPa"})
    raw = raw.withColumns({"isobaricInhPa": F.col("isobaricInhPa") / 100, "lon": F.col("lon") + 360})
    folder = fresh_folder(spark, "merged")
    # Dealt by day: else every task of the join writes a file for every day.
    raw.hint("rebalance", "date").sortWithinPartitions("date").write.partitionBy("date").parquet(folder)
    state = load_state(spark, SourceSpec("merged", folder, "2024-01-01T02", "2024-01-02T05"), BLENDED)
    return rounded(state.upper.select(*UPPER_KEYS, *fields), 9)


def load_per_variable(spark, sf_dir):
    """The per-variable layout, ground and upper air side by side."""
    folder = fresh_folder(spark, "variables")
    write_per_variable(spark, sf_dir, folder)
    state = load_state(spark, SourceSpec("per_variable", folder, units={"T": "C", "T2m": "K"}), BLENDED)
    fields = (*SURFACE_FIELDS, *NEAR_SURFACE_FIELDS)
    return rounded(state.rows(UPPER_FIELDS, fields).select(*UPPER_KEYS, *UPPER_FIELDS, *fields), 9)


def quality_report_broken(spark, sf_dir):
    """A state with every fault: repeated keys, holes in both tables, a missing hour, axes read backwards, Celsius."""
    points = gridded_events(spark.read.parquet(f"{sf_dir}/events.parquet")).where("event_id DIV 100 <> 3")
    upper = points.where("event_id % 1000 <> 77").unionByName(points.where("event_id % 500 = 13"))
    upper = with_unit(upper.withColumn("place", -F.col("event_id")), "T", "C")
    surface = points.where("layer = 0 AND event_id % 700 <> 5").select(*SURFACE_KEYS, "sp")
    surface = surface.unionByName(points.where("event_id % 400 = 2").select(*SURFACE_KEYS, "sp"))
    return quality_report(GridState(upper, surface), order="place")


def quality_report_columns(spark, sf_dir):
    """The events as they are, taken for a state: what they lack of the keys and fields."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("ts", "time")
    return quality_report(GridState(table, table))


#: Requests that the grid cannot meet, and one that it can.
REFUSED = {
    "good": GROUND, "south": BoxRequest(bbox=(39.0, 60.0, -130.0, -110.0)), "north": BoxRequest(bbox=(40.0, 60.5, -130.0, -110.0)),
    "west": BoxRequest(bbox=(40.0, 60.0, -131.0, -110.0)), "east": BoxRequest(bbox=(40.0, 60.0, -130.0, -109.0)),
    "thin": BoxRequest(bbox=(42.0, 48.0, -130.0, -110.0)), "margin": BoxRequest(margin=2), "deep": BoxRequest(bottom_pressure=110000.0),
    "high": BoxRequest(top_pressure=60000.0, bottom_pressure=90000.0), "upside_down": BoxRequest(top_pressure=90000.0, bottom_pressure=80000.0),
}


def request_refusals(spark, sf_dir):
    return refusals(_state(spark, sf_dir), REFUSED)


def budget_cropped(spark, sf_dir):
    """The halo alone is stored, and the budget taken from it."""
    state, box = _boxed(spark, sf_dir)
    folder = fresh_folder(spark, "halo")
    write_state(box.crop(state), folder)
    return scaled_budget(run_budget(read_state(spark, folder), box))


def resolved_box(spark, sf_dir):
    """One row: the bounds of the domain after snapping and margin."""
    spec = _boxed(spark, sf_dir, BoxRequest(bbox=(41.0, 59.0, -129.0, -111.0)))[1].spec
    return spark.createDataFrame([(*spec.lat, *spec.lon, spec.top_pressure)], "lat_low double, lat_high double, lon_low double, lon_high double, top double")


QUERIES: dict[str, Query] = {
    "cell_edges": cell_edges,
    "bbox_cells": bbox_cells,
    "halo_flags": halo_flags,
    "horizontal_area": horizontal_area,
    "wall_area": wall_area,
    "cell_volume": cell_volume,
    "harmonise": harmonised,
    "merge_sources": merge_variables,
    "merge_twins": merge_twins,
    "merge_clashes": merge_conflicts,
    "time_slice": time_slice,
    "quality_report": quality,
    "time_regularity": time_regularity,
    "top_bottom_weight": top_bottom_weight,
    "wall_weight": _wall_weight(GROUND, CLIPPED),
    "wall_weight_overflow": _wall_weight(GROUND, OVERFLOW),
    "wall_weight_level": _wall_weight(LEVEL, OVERFLOW),
    "volume_weight": _volume_weight(GROUND, CLIPPED),
    "volume_weight_overflow": _volume_weight(GROUND, OVERFLOW),
    "volume_weight_level": _volume_weight(LEVEL, OVERFLOW),
    "domain_volume": volume,
    "domain_mean_t": domain_mean_t,
    "heat_storage": heat_storage,
    "adiabatic": adiabatic,
    "centered_diff": centered_diff,
    "rolling_24h": rolling_24h,
    "running_integral": running_integral,
    "daily_rollup": daily_rollup,
    "surface_mask": surface_mask,
    "surface_blend": surface_blend,
    "surface_share": surface_share,
    "wall_faces": faces,
    "top_face": top_face,
    "top_flux": top_flux,
    "wall_flux": wall_flux,
    "net_heat": _budget_rate("net_heat_advection"),
    "net_mass": _budget_rate("net_mass_advection"),
    "mass_residual": _summary(diagnostics.mass_residual_summary),
    "mass_residual_hourly": mass_residual_hourly,
    "t_scale": t_scale,
    "advection_error": _budget_rate("advection_error"),
    "diabatic": _budget_rate("diabatic_term"),
    "budget": _budget(GROUND, OVERFLOW),
    "budget_clipped": _budget(GROUND, CLIPPED),
    "budget_level": _budget(LEVEL, OVERFLOW),
    "budget_blended": _budget(GROUND, BLENDED),
    "budget_level_blended": _budget(LEVEL, BLENDED),
    "budget_stored": budget_stored,
    "budget_stored_blended": budget_stored_blended,
    "budget_appended": budget_appended,
    "budget_gaps": budget_gaps,
    "budget_incremental": budget_incremental,
    "budget_many": budget_many,
    "budget_written": budget_written,
    "budget_checked": budget_checked,
    "load_merged": load_merged,
    "load_per_variable": load_per_variable,
    "quality_report_broken": quality_report_broken,
    "quality_report_columns": quality_report_columns,
    "quality_report_stored": quality_stored,
    "request_refusals": request_refusals,
    "budget_cropped": budget_cropped,
    "resolved_box": resolved_box,
    "constant_t": _summary(diagnostics.constant_temperature_check),
    "constant_t_budget": constant_t_budget,
    "mass_continuity": _summary(diagnostics.mass_continuity, ("dV_dt", "net_mass_advection", "plot_limit"), 1e9),
    "quantile_residual": quantile_residual,
    "mass_series": _summary(diagnostics.mass_series),
    "mass_cumulative": _summary(diagnostics.mass_cumulative),
    "mass_error": _summary(diagnostics.mass_error),
    "mass_error_whole_run": _summary(lambda run: diagnostics.mass_error(run, whole_run=True), digits=9),
    "mass_direction": _summary(diagnostics.mass_direction),
    "mass_direction_cumulative": _summary(diagnostics.mass_direction_cumulative),
    "heat_walls": _summary(diagnostics.heat_walls),
    "storage_forms": _summary(diagnostics.storage_forms),
    "hourly_view": _summary(lambda run: diagnostics.hourly_view(run, 1), ("domain_volume",), 1e15),
    "hourly_view_24h": _summary(lambda run: diagnostics.hourly_view(run, 24), ("domain_volume",), 1e15),
    "daily_view": _summary(diagnostics.daily_view, ("domain_volume",), 1e15),
    "closure": _summary(diagnostics.closure),
}
