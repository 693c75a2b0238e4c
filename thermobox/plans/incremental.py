"""Budgets that grow by days: the sums of each hour are stored, a new day adds its hours.

Everything a budget needs of the cells are sums per hour. T_scale and the means merge from the stored counts, sums and
squares, so adding a day reads that day only, and a day written again replaces its hours.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from thermobox.operators.domain import Box, resolve_box
from thermobox.operators.series import index_by
from thermobox.plans.budget import BudgetRun, hourly_moments
from thermobox.sources.layout import write_hours
from thermobox.sources.state import GridState
from thermobox.specs import BoxRequest, BoxSpec, SurfacePolicy


def _stated(spark: SparkSession, path: str) -> dict | None:
    """What the stored sums are of; None where nothing is stored."""
    try:
        return json.loads(spark.read.text(f"{path}/box").first()["value"])
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_moments(
    state: GridState, request: BoxRequest | Box, policy: SurfacePolicy, path: str, append: bool = False
) -> None:
    """Store the hourly sums of `state` by year. With `append` the days of `state` are added or replaced.

    The box, snapped to the grid, and the policy must be those of the stored hours.
    """
    spark = state.upper.sparkSession
    box = request if isinstance(request, Box) else resolve_box(state, request)
    wanted = json.loads(json.dumps({"spec": asdict(box.spec), "policy": asdict(policy)}))
    known = _stated(spark, path) if append else None
    if known is not None and known != wanted:
        raise ValueError(f"the stored hours are of {known}, not of {wanted}")
    write_hours(hourly_moments(state, box, policy), f"{path}/hours", append)
    if known is None:
        spark.createDataFrame([(json.dumps(wanted),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/box")


def read_run(spark: SparkSession, path: str) -> BudgetRun:
    """The budget of all stored hours; no cell is read."""
    stated = _stated(spark, path)
    if stated is None:
        raise ValueError(f"no hours are stored in {path}")
    spec = BoxSpec(**{k: tuple(v) if isinstance(v, list) else v for k, v in stated["spec"].items()})
    return BudgetRun(spec, index_by(spark.read.parquet(f"{path}/hours").drop("year")))
