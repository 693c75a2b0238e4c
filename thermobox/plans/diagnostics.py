"""Summary tables of a budget run. They read its per-time rows only.

Rates are given per hour and divided by a volume (K/h or 1/h); `scale` columns and
mean volume enter as one-row scalar subqueries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermobox.operators.series import (
    Series,
    daily,
    index_by,
    quantiles,
    rolling_mean,
    running_sum,
    step_seconds,
)
from thermobox.plans.budget import BudgetRun
from thermobox.specs import SECONDS_PER_HOUR

DIRECTIONS = {
    "zonal": ("west", "east"),
    "meridional": ("south", "north"),
    "vertical": ("top", "bottom"),
}
# How each term enters S = -A + C + D.
TERM_SIGN = {"advection_term": -1.0, "adiabatic_term": 1.0, "diabatic_term": 1.0}
TERMS_WITH_ERROR = ("advection_term", "diabatic_term")
QUANTILE_BINS = 20


def per_hour(rate: Column, volume: Column) -> Column:
    """A rate per second and box as a rate per hour and unit volume."""
    return F.try_divide(rate * F.lit(SECONDS_PER_HOUR), volume)


def _own_volume(name: str) -> Column:
    return per_hour(F.col(name), F.col("domain_volume"))


def _mean_volume(run: BudgetRun) -> DataFrame:
    return run.table().agg(F.avg("domain_volume").alias("mean_volume"))


def _with_mass(run: BudgetRun) -> Series:
    """Budget series with dM = dV/dt + net mass flow, the mean volume and the time step."""
    series = run.series
    frame = series.frame.withColumns({
        "delta_mass": F.col("dV_dt") + F.col("net_mass_advection"),
        "mean_volume": _mean_volume(run).scalar(),
        "dt": step_seconds(run.moments).scalar(),
    })
    return series.map(frame)


def _by_mean_volume(name: str) -> Column:
    return per_hour(F.col(name), F.col("mean_volume"))


def mass_continuity(run: BudgetRun) -> DataFrame:
    """dV/dt against net mass flow; `plot_limit` is the largest size of either over the run."""
    size = F.greatest(F.abs(F.col("dV_dt")), F.abs(F.col("net_mass_advection")))
    limit = run.series.frame.agg(F.max(size).alias("plot_limit")).scalar()
    return run.series.frame.select("time", "dV_dt", "net_mass_advection").withColumn("plot_limit", limit)


def binned_means(frame: DataFrame, by: str, names: Sequence[str], bins: int = QUANTILE_BINS) -> DataFrame:
    """Mean of columns in quantile bins of `by`; empty bins are kept.

    A bin is the number of inner edges at or below the value, so equal values share a bin.
    """
    others = [name for name in names if name != by]
    ordered = index_by(frame.select(by, *others).where(F.col(by).isNotNull()), by, others)
    edges = quantiles(ordered, [i / bins for i in range(1, bins)])
    bound = edges.select(F.array(*edges.columns).alias("edges"))
    placed = ordered.frame.withColumn("edges", bound.scalar()).withColumn(
        "bin", F.size(F.filter("edges", lambda edge: edge <= F.col(by)))
    )
    means = placed.groupBy("bin").agg(F.count(by).alias("n"), *[F.avg(name).alias(f"mean_{name}") for name in names])
    all_bins = frame.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(means, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def binned_residual(run: BudgetRun, bins: int = QUANTILE_BINS, key: Column | None = None) -> DataFrame:
    """Mean dV/dt and mean mass residual in quantile bins of dV/dt, or of `key`, a coarser form of it.

    Hours can share a value up to the last bits, which then decide their bins; a rounded key keeps them together.
    """
    frame = run.series.frame.withColumn("residual", F.col("net_mass_advection") + F.col("dV_dt"))
    frame = frame.withColumn("key", F.col("dV_dt") if key is None else key)
    return binned_means(frame, "key", ("dV_dt", "residual"), bins)


def mass_series(run: BudgetRun) -> DataFrame:
    """Mass residual and its two parts per mean volume, 1/h."""
    names = ("delta_mass", "net_mass_advection", "dV_dt")
    return _with_mass(run).frame.select("time", *[_by_mean_volume(name).alias(name) for name in names])


def mass_cumulative(run: BudgetRun) -> DataFrame:
    """Running time integrals of the mass residual and its parts per mean volume."""
    names = ("delta_mass", "net_mass_advection", "dV_dt")
    summed = running_sum(_with_mass(run), {f"sum_{n}": F.col(n) * F.col("dt") for n in names})
    return summed.frame.select(
        "time", *[F.try_divide(F.col(f"sum_{n}"), F.col("mean_volume")).alias(f"cumulative_{n}") for n in names]
    )


def mass_error(run: BudgetRun, whole_run: bool = False) -> DataFrame:
    """|dM| relative to the gross mass flow of the same hour.

    With `whole_run` the divisor is one number: the absolute sum over all times of the
    wall mass flows, both net flows and the residual fraction.
    """
    walls = run.spec.walls
    series = _with_mass(run)
    names = [f"mass_flux_contribution_{wall}" for wall in walls]
    if whole_run:
        names += ["net_heat_advection", "net_mass_advection", "abs_mass_advection_residual_fraction"]
    gross = sum(F.abs(F.col(name)) for name in names)
    frame = series.frame
    if whole_run:
        frame = frame.withColumn("gross", frame.agg(F.sum(gross).alias("gross")).scalar())
    else:
        frame = frame.withColumn("gross", gross)
    return frame.select("time", F.try_divide(F.abs(F.col("delta_mass")), F.col("gross")).alias("mass_error"))


def _directions(run: BudgetRun, value) -> dict[str, Column]:
    """Sum of `value(wall)` over the walls of each direction."""
    walls = run.spec.walls
    sums = {
        name: sum(value(wall) for wall in pair if wall in walls) for name, pair in DIRECTIONS.items()
    }
    sums["horizontal"] = sums["zonal"] + sums["meridional"]
    return sums


def mass_direction(run: BudgetRun, window: int = 24) -> DataFrame:
    """Smoothed mass flow by wall and direction per mean volume, 1/h; the residual unsmoothed."""
    walls = run.spec.walls
    names = [f"mass_flux_contribution_{wall}" for wall in walls]
    frame = rolling_mean(_with_mass(run), names, window).frame
    sums = _directions(run, lambda wall: _by_mean_volume(f"mass_flux_contribution_{wall}"))
    return frame.select(
        "time",
        _by_mean_volume("delta_mass").alias("delta_mass"),
        *[_by_mean_volume(f"mass_flux_contribution_{wall}").alias(f"mass_{wall}") for wall in walls],
        *[column.alias(name) for name, column in sums.items()],
    )


def mass_direction_cumulative(run: BudgetRun) -> DataFrame:
    """Running integrals of the unsmoothed mass flow by direction per mean volume."""
    walls = run.spec.walls
    totals = {f"sum_{wall}": F.col(f"mass_flux_contribution_{wall}") * F.col("dt") for wall in walls}
    totals["sum_residual"] = F.col("delta_mass") * F.col("dt")
    frame = running_sum(_with_mass(run), totals).frame
    sums = _directions(run, lambda wall: F.try_divide(F.col(f"sum_{wall}"), F.col("mean_volume")))
    return frame.select(
        "time",
        F.try_divide(F.col("sum_residual"), F.col("mean_volume")).alias("cumulative_residual"),
        *[column.alias(f"cumulative_{name}") for name, column in sums.items()],
    )


def heat_walls(run: BudgetRun) -> DataFrame:
    """Heat flow of each wall, their sum and the residual expected from mass, K/h."""
    walls = run.spec.walls
    return run.series.frame.select(
        "time",
        *[_own_volume(f"flux_contribution_{wall}").alias(f"heat_{wall}") for wall in walls],
        _own_volume("net_heat_advection").alias("net_heat"),
        _own_volume("advection_error").alias("expected_residual"),
    )


def storage_forms(run: BudgetRun) -> DataFrame:
    """The three forms of the storage rate side by side, K/h."""
    return run.table().select("time", *[_own_volume(n).alias(n) for n in ("d_dt_T", "dT_dt_2", "dT_dt")])


def _signed_terms() -> dict[str, Column]:
    return {name: F.lit(sign) * _own_volume(name) for name, sign in TERM_SIGN.items()}


def _bands(frame: DataFrame) -> DataFrame:
    """Lower and upper edge of the error band of advection and residual."""
    edges = {}
    for name in TERMS_WITH_ERROR:
        edges[f"{name}_low"] = F.col(name) - F.col("error")
        edges[f"{name}_high"] = F.col(name) + F.col("error")
    return frame.withColumns(edges)


def hourly_view(run: BudgetRun, window: int) -> DataFrame:
    """Volume, <T>, storage, closure and signed terms (K/h), smoothed over `window` hours."""
    terms = _signed_terms()
    rates = run.series.frame.select(
        "time", "step", "domain_volume", "T_domain_avg",
        _own_volume("dT_dt").alias("dT_dt"),
        sum(terms.values()).alias("dT_dt_from_terms"),
        *[column.alias(name) for name, column in terms.items()],
        F.abs(_own_volume("advection_error")).alias("error"),
    )
    names = [name for name in rates.columns if name not in ("time", "step")]
    return _bands(rolling_mean(run.series.map(rates), names, window).frame.drop("step"))


def daily_view(run: BudgetRun) -> DataFrame:
    """Daily mean volume and <T>, daily sums of the rates (K/day) with error bands."""
    sums = {
        "d_dt_T": _own_volume("d_dt_T"),
        "dT_from_dV": F.col("T_domain_avg") * _own_volume("dV_dt"),
        "dT_dt": _own_volume("dT_dt"),
        **_signed_terms(),
        "error": F.abs(_own_volume("advection_error")),
    }
    return _bands(daily(run.table(), ["domain_volume", "T_domain_avg"], sums))


def closure(run: BudgetRun) -> DataFrame:
    """-A + C + D against the storage rate, K/h; the gap is rounding only."""
    rebuilt = sum(_signed_terms().values())
    return run.table().select(
        "time", _own_volume("dT_dt").alias("dT_dt"), rebuilt.alias("dT_dt_from_terms"),
        (rebuilt - _own_volume("dT_dt")).alias("gap"),
    )


def constant_temperature_check(run: BudgetRun) -> DataFrame:
    """Mass-error estimate against the heat flow of the constant-T run, with running integrals.

    Both are divided by the volume of the first run.
    """
    test = run.constant_temperature().series.frame.select("time", F.col("advection_term").alias("test_advection"))
    series = run.series
    frame = series.frame.join(test, "time").withColumn("dt", step_seconds(run.moments).scalar())
    volume = F.col("domain_volume")
    rates = {"advection_error": F.col("advection_error"), "test_advection": F.col("test_advection")}
    summed = running_sum(
        series.map(frame),
        {f"sum_{name}": F.try_divide(rate * F.col("dt"), volume) for name, rate in rates.items()},
    )
    return summed.frame.select(
        "time",
        *[per_hour(rate, volume).alias(name) for name, rate in rates.items()],
        *[F.col(f"sum_{name}").alias(f"integrated_{name}") for name in rates],
    )


def mass_residual_summary(run: BudgetRun) -> DataFrame:
    """Mean and largest mass residual fraction over the run."""
    fraction = "abs_mass_advection_residual_fraction"
    return run.advection().agg(F.avg(fraction).alias("mean_fraction"), F.max(fraction).alias("max_fraction"))
