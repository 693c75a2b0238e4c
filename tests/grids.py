"""Small grids for tests, as DataFrames."""

from __future__ import annotations

import datetime as dt
import itertools

import pandas as pd
from pyspark.sql import functions as F

from thermobox.sources.state import GridState
from thermobox.specs import BoxRequest

HPA = 100.0


def hours(n, start=dt.datetime(2000, 1, 1)):
    return [start + dt.timedelta(hours=i) for i in range(n)]


def make_state(spark, *, level, lat, lon, times=None, T=300.0, u=0.0, v=0.0, w=0.0, sp=100000.0):
    """Fields are numbers or functions of (t, k, i, j); sp and near-surface ones of (t, i, j)."""
    times = hours(1) if times is None else times
    level, lat, lon = ([float(x) for x in axis] for axis in (level, lat, lon))

    def pick(field, *index):
        return field(*index) if callable(field) else field

    upper = [
        (t, level[k], lat[i], lon[j], *(pick(f, n, k, i, j) for f in (T, u, v, w)))
        for (n, t), k, i, j in itertools.product(
            enumerate(times), range(len(level)), range(len(lat)), range(len(lon)))
    ]
    ground = [
        (t, lat[i], lon[j], pick(sp, n, i, j), 285.0 + i, 1.0 + j, 2.0 + n)
        for (n, t), i, j in itertools.product(enumerate(times), range(len(lat)), range(len(lon)))
    ]
    upper_df = spark.createDataFrame(
        upper, "time timestamp_ntz, level double, lat double, lon double, T double, u double, v double, w double")
    ground_df = spark.createDataFrame(
        ground, "time timestamp_ntz, lat double, lon double, sp double, T2m double, u10 double, v10 double")
    return GridState(upper_df, ground_df)


def wide_of(state: GridState) -> GridState:
    return GridState(state.rows(("T", "u", "v", "w"), ("sp", "T2m", "u10", "v10")))


def pressure_box(bbox, margin=1, top=500 * HPA, bottom=1000 * HPA):
    return BoxRequest(bbox=bbox, margin=margin, top_pressure=top, bottom_pressure=bottom)


def ground_box(bbox, margin=1, top=500 * HPA):
    return BoxRequest(bbox=bbox, margin=margin, top_pressure=top)


def frame(df, *order) -> pd.DataFrame:
    return df.orderBy(*order).toPandas() if order else df.toPandas()


def cells(df, value, *keys):
    """{key tuple: value}"""
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}


def null_where(df, condition, *names):
    return df.withColumns({n: F.when(~condition, F.col(n)) for n in names})
