"""The heat budget: S = -A + C + D, one row per interior time."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermobox.operators.domain import Box, resolve_box
from thermobox.operators.series import Series, centered_difference, index_by
from thermobox.operators.volume import volume_moments
from thermobox.operators.walls import advection_columns, wall_faces, wall_sums
from thermobox.sources.state import GridState
from thermobox.specs import ANCHOR_K, BoxRequest, BoxSpec, SurfacePolicy

# Names of the result fields.
BUDGET_FIELDS = (
    "d_dt_T", "dT_dt", "dT_dt_2", "dV_dt", "advection_term", "advection_error",
    "adiabatic_term", "diabatic_term", "T_domain_avg", "domain_volume", "T_scale",
)


def mean_temperature() -> Column:
    return F.try_divide(F.col("heat"), F.col("volume"))


def hourly_moments(state: GridState, box: Box, policy: SurfacePolicy) -> DataFrame:
    """All sums a budget needs, one row per time, in two scans.

    The first reads T and w of the domain, the second T, u and v of the ring. Neither
    waits for the other: the shift of T by the domain mean is applied to the sums. An hour that only one of
    them has, or only the hours of the state, is kept: a sum over nothing is 0.
    """
    volume, walls = volume_moments(state, box, policy), wall_sums(wall_faces(state, box, policy))
    joined = volume.join(walls, "time", "full_outer")
    if state.hours is not None:
        joined = state.hours.join(joined, "time", "full_outer")
    kept = ("time", "warmth", "warmth2")
    return joined.select(*[F.col(c) if c in kept else F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in joined.dtypes])


def temperature_spread(moments: DataFrame, *keys: str) -> DataFrame:
    """T_scale as one row, or one per `keys`: root mean square of T - <T> over all cells and times, unweighted.

    From count, sum and sum of squares per time; times without a mean do not count.
    """
    shift = mean_temperature() - F.lit(ANCHOR_K)
    known = F.when(shift.isNotNull(), F.col("cells"))
    squares = F.col("warmth2") - 2 * shift * F.col("warmth") + shift * shift * F.col("cells")
    return moments.groupBy(*keys).agg(F.sqrt(F.try_divide(F.sum(squares), F.sum(known))).alias("T_scale"))


def mean_of_means(moments: DataFrame) -> DataFrame:
    """T_scale of a run with constant T: the time mean of <T>."""
    return moments.agg(F.avg(mean_temperature()).alias("T_scale"))


#: {rate: the sum or mean that it is the centred difference of}
RATES_OF = {"dV_dt": "volume", "d_dt_T": "heat", "d_mean_dt": "T_domain_avg"}


def signed_terms(moments: DataFrame, spec: BoxSpec, anomalies: bool = True) -> DataFrame:
    """`moments` with T_domain_avg and the signed flows of heat relative to it."""
    frame = moments.withColumn("T_domain_avg", mean_temperature())
    shift = F.col("T_domain_avg") - F.lit(ANCHOR_K) if anomalies else F.lit(-ANCHOR_K)
    return frame.select("*", *advection_columns(spec, shift))


def budget_terms(rates: DataFrame) -> DataFrame:
    """The fields of the budget from signed terms, their rates of change and T_scale."""
    return (
        rates.withColumn("dT_dt", F.col("volume") * F.col("d_mean_dt"))
        .withColumn("dT_dt_2", F.col("d_dt_T") - F.col("T_domain_avg") * F.col("dV_dt"))
        .withColumn("advection_error", (F.col("dV_dt") + F.col("net_mass_advection")) * F.col("T_scale"))
        .withColumn("diabatic_term", F.col("dT_dt") + F.col("net_heat_advection") - F.col("adiabatic"))
        .withColumnsRenamed({"volume": "domain_volume", "adiabatic": "adiabatic_term"})
        .withColumn("advection_term", F.col("net_heat_advection"))
    )


@dataclass(frozen=True)
class BudgetRun:
    """A finished pass over the state; every table below reads only its per-time rows."""

    spec: BoxSpec
    moments: Series
    anomalies: bool = True
    box: Box | None = None  # where the run has read cells

    @cached_property
    def _terms(self) -> Series:
        signed = signed_terms(self.moments.frame, self.spec, self.anomalies)
        rates = centered_difference(self.moments.map(signed), RATES_OF)
        scale = temperature_spread if self.anomalies else mean_of_means
        return rates.map(budget_terms(rates.frame.withColumn("T_scale", scale(self.moments.frame).scalar())))

    @property
    def series(self) -> Series:
        """Budget fields and signed wall contributions by position, for the summary tables."""
        walls = self.spec.walls
        return self._terms.map(self._terms.frame.select(
            "time", "step", *BUDGET_FIELDS,
            "net_heat_advection", "net_mass_advection", "abs_mass_advection_residual_fraction",
            *[f"flux_contribution_{wall}" for wall in walls],
            *[f"mass_flux_contribution_{wall}" for wall in walls],
        ))

    def table(self) -> DataFrame:
        """The budget: time and its 11 fields."""
        return self._terms.frame.select("time", *BUDGET_FIELDS)

    def advection(self) -> DataFrame:
        """Net and per-wall advection of heat and mass, interior times."""
        return self.series.frame.drop("step", *BUDGET_FIELDS)

    def constant_temperature(self) -> BudgetRun:
        """The same run with T = T_scale everywhere, from the sums already taken.

        With T constant every heat sum is that constant times its mass sum, so the state
        is not read again.
        """
        constant = temperature_spread(self.moments.frame).scalar()
        walls = self.spec.walls
        frame = self.moments.frame.withColumn("_c", constant)
        c = F.col("_c")
        replaced = frame.withColumns({
            "heat": c * F.col("volume"),
            "adiabatic": c * F.col("lift"),
            **{f"heat_{wall}": (c - F.lit(ANCHOR_K)) * F.col(f"mass_{wall}") for wall in walls},
            **{f"warm_{wall}": F.col(f"mass_{wall}") for wall in walls},
        }).drop("_c")
        return BudgetRun(self.spec, self.moments.map(replaced), anomalies=False, box=self.box)


def run_budget(
    state: GridState,
    request: BoxRequest | Box,
    policy: SurfacePolicy = SurfacePolicy(),
    anomalies: bool = True,
) -> BudgetRun:
    """Read the state once, store the per-time sums, return the run."""
    box = request if isinstance(request, Box) else resolve_box(state, request)
    return BudgetRun(box.spec, index_by(hourly_moments(state, box, policy)), anomalies, box)
