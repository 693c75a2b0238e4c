"""From raw tables to a budget in one call."""

from __future__ import annotations

from pyspark.sql import SparkSession

from thermobox.plans.budget import BudgetRun, run_budget
from thermobox.sources.layout import read_state, write_state
from thermobox.sources.quality import validate
from thermobox.sources.readers import load_state, wanted_fields
from thermobox.sources.state import UPPER_FIELDS, GridState
from thermobox.specs import BoxRequest, SourceSpec, SurfacePolicy


def checked_run(state: GridState, request: BoxRequest, policy: SurfacePolicy = SurfacePolicy()) -> BudgetRun:
    """A budget of a state without holes: a missing cell, ground value or hour is an error here.

    Blending takes the value above a cut layer, and time differences take the hours on both sides, so
    both rely on it.
    """
    return run_budget(validate(state), request, policy)


def run_source(
    spark: SparkSession, source: SourceSpec, request: BoxRequest, policy: SurfacePolicy, folder: str
) -> tuple[BudgetRun, BudgetRun]:
    """Load, store as a wide table in `folder`, validate what is stored, run; also the run with constant T."""
    fields = tuple(name for name in wanted_fields(policy) if name not in UPPER_FIELDS)
    write_state(load_state(spark, source, policy, coordinates=True), folder, fields)
    run = checked_run(read_state(spark, folder), request, policy)
    return run, run.constant_temperature()
