import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.grids import hours
from thermobox.operators.series import (
    centered_difference,
    daily,
    index_by,
    is_regular,
    quantiles,
    rolling_mean,
    running_sum,
)

SIZES = [(1, 4), (2, 4), (3, 2), (50, 7), (50, 3), (101, 1000)]


def make(spark, n, missing=()):
    rng = random.Random(n)
    rows = [(t, None if i in missing else rng.uniform(-5, 5)) for i, t in enumerate(hours(n))]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    return spark.createDataFrame(shuffled, "time timestamp_ntz, x double").repartition(5), pd.DataFrame(rows, columns=["time", "x"])


def values(df, name):
    return np.array([np.nan if r[0] is None else r[0] for r in df.orderBy("time").select(name).collect()], dtype=float)


@pytest.mark.parametrize("n, block", SIZES)
def test_positions(spark, n, block):
    series = index_by(make(spark, n)[0], block_rows=block)
    assert series.length == n
    assert [r.step for r in series.frame.orderBy("time").collect()] == list(range(n))


@pytest.mark.parametrize("n, block", SIZES)
def test_centered_difference(spark, n, block):
    df, want = make(spark, n, missing={7})
    got = values(centered_difference(index_by(df, block_rows=block), {"rate": "x"}).frame, "rate")
    x = want.x.astype(float).to_numpy()
    expected = (x[2:] - x[:-2]) / 7200.0
    np.testing.assert_allclose(got, expected, rtol=1e-12)


@pytest.mark.parametrize("window", [1, 2, 3, 24])
@pytest.mark.parametrize("n, block", SIZES)
def test_rolling_mean(spark, n, block, window):
    df, want = make(spark, n, missing={30})
    got = values(rolling_mean(index_by(df, block_rows=block), ["x"], window).frame, "x")
    x = want.x.astype(float).to_numpy()
    expected = np.full(n, np.nan)
    for i in range(n):
        low, high = i - window // 2, i + window - 1 - window // 2
        if low >= 0 and high < n:
            expected[i] = x[low:high + 1].mean()
    np.testing.assert_allclose(got, expected, rtol=1e-12)


@pytest.mark.parametrize("n, block", SIZES)
def test_running_sum(spark, n, block):
    df, want = make(spark, n, missing={7})
    got = values(running_sum(index_by(df, block_rows=block), {"total": F.col("x") * 2}).frame, "total")
    np.testing.assert_allclose(got, (want.x.astype(float).fillna(0) * 2).cumsum(), rtol=1e-12, atol=1e-12)


def test_running_sum_after_ends_drop(spark):
    """Positions stay those of the full series after a centred difference."""
    df, want = make(spark, 40)
    inner = centered_difference(index_by(df, block_rows=6), {"rate": "x"})
    got = values(running_sum(inner, {"total": F.col("rate")}).frame, "total")
    x = want.x.to_numpy()
    np.testing.assert_allclose(got, np.cumsum((x[2:] - x[:-2]) / 7200), rtol=1e-9, atol=1e-12)


def test_numeric_time(spark):
    df = spark.createDataFrame([(float(t), float(t * t)) for t in (0, 1, 3, 6)], "time double, x double")
    rows = centered_difference(index_by(df), {"rate": "x"}).frame.orderBy("time").collect()
    assert [r.rate for r in rows] == [3.0, 7.0]


@pytest.mark.parametrize("n", [1, 2, 20, 57])
def test_exact_quantiles(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=n), 1)
    df = spark.createDataFrame([(float(a),) for a in x], "x double").repartition(3)
    probabilities = [i / 20 for i in range(21)]
    got = list(quantiles(index_by(df, "x"), probabilities).first())
    np.testing.assert_allclose(got, np.quantile(x, probabilities), rtol=1e-12, atol=1e-12)


def test_daily(spark):
    df, want = make(spark, 50, missing=set(range(24, 48)))
    rows = daily(df.withColumn("m", F.col("x")), ["m"], {"s": F.col("x")}).orderBy("day").collect()
    by_day = want.assign(x=want.x.astype(float)).groupby(want.time.dt.date).x
    assert [r.s for r in rows] == pytest.approx(list(by_day.sum()))
    assert rows[1].m is None and rows[1].s == 0.0
    assert rows[0].day == dt.datetime(2000, 1, 1)


def test_regular_steps(spark):
    def regular(times):
        return is_regular(spark.createDataFrame([(t,) for t in times], "time timestamp_ntz")).first().regular

    assert regular(hours(5)) and regular(hours(2)) and regular(hours(1))
    assert regular(hours(5) + hours(3))
    assert not regular(hours(5)[:2] + hours(5)[3:])
    assert not regular([*hours(3), hours(4)[3] + dt.timedelta(microseconds=1)])
    numbers = spark.createDataFrame([(0.1,), (0.2,), (0.3,)], "time double")
    assert is_regular(numbers).first().regular
