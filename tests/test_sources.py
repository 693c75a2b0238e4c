import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.grids import frame, hours, make_state, wide_of
from thermobox.plans.budget import BUDGET_FIELDS, run_budget
from thermobox.sources.harmonise import harmonise, slice_time, to_kelvin, unit_of, with_unit
from thermobox.operators.axes import coordinate_axes
from thermobox.plans.run import checked_run
from thermobox.sources.layout import read_state, write_budget, write_state
from thermobox.sources.quality import quality_report, validate
from thermobox.sources.readers import (
    VARIABLE_FILES,
    load_state,
    merge_clashes,
    merge_sources,
    merge_tables,
)
from thermobox.sources.state import SURFACE_KEYS, UPPER_KEYS, GridState
from thermobox.specs import BoxRequest, SourceSpec, SurfacePolicy

LEVELS = [100000.0, 90000.0, 80000.0, 70000.0]
GRID = dict(level=LEVELS, lat=[40, 45, 50, 55, 60], lon=[-130, -125, -120, -115, -110])
BLENDED = SurfacePolicy(surface_mode="combined")


@pytest.fixture(scope="module")
def state(spark):
    return make_state(
        spark, **GRID, times=hours(5), T=lambda t, k, i, j: 280.0 + t - 3 * k + i * j, u=lambda t, k, i, j: 1.0 + i - t,
        v=lambda t, k, i, j: 2.0 - j, w=lambda t, k, i, j: 0.01 * (k + t), sp=lambda t, i, j: 90000.0 + 1000 * i + 500 * t)


def raw_tables(state):
    """The state under external names, one table per variable."""
    upper = state.upper.selectExpr(
        "time AS valid_time", "level / 100 AS isobaricInhPa", "lat AS latitude",
        "if(lon < 0, lon + 360, lon) AS longitude", "0 AS number", "'x' AS expver", "T - 273.15 AS t", "u", "v", "w")
    ground = state.surface.selectExpr(
        "time AS valid_time", "lat AS latitude", "if(lon < 0, lon + 360, lon) AS longitude", "sp", "T2m AS t2m", "u10", "v10")
    upper_keys = ["valid_time", "isobaricInhPa", "latitude", "longitude", "number", "expver"]
    tables = {}
    for name, (_, raw) in VARIABLE_FILES.items():
        source, keys = (upper, upper_keys) if raw in upper.columns else (ground, ["valid_time", "latitude", "longitude"])
        tables[name] = source.select(*keys, raw)
    tables["T"] = with_unit(tables["T"], "t", "C")
    tables["T2m"] = with_unit(tables["T2m"], "t2m", "K")
    return tables


def same_budget(state, other, policy=SurfacePolicy()):
    one, two = (frame(run_budget(s, BoxRequest(), policy).table(), "time") for s in (state, other))
    for name in BUDGET_FIELDS:
        np.testing.assert_allclose(one[name], two[name], rtol=1e-7, atol=1e-3, err_msg=name)


def test_per_variable_source(spark, state, tmp_path):
    for name, table in raw_tables(state).items():
        table.write.parquet(f"{tmp_path}/{VARIABLE_FILES[name][0]}.parquet")
    loaded = load_state(spark, SourceSpec("per_variable", str(tmp_path)), BLENDED)
    assert unit_of(loaded.upper, "T") == "K"
    got, want = (frame(s.upper, *UPPER_KEYS) for s in (loaded, state))
    for name in want.columns:
        if name != "time":
            np.testing.assert_allclose(got[name], want[name], rtol=1e-12)
    same_budget(state, loaded, BLENDED)


def test_merged_source(spark, state, tmp_path):
    raw = wide_of(state).upper.selectExpr(
        "time", "level / 100 AS pressure_level", "lat AS latitude", "if(lon < 0, lon + 360, lon) AS longitude",
        "T AS temperature", "u AS u_component_of_wind", "v AS v_component_of_wind", "w AS vertical_velocity",
        "sp AS surface_pressure", "T2m AS `2m_temperature`", "u10 AS `10m_u_component_of_wind`",
        "v10 AS `10m_v_component_of_wind`", "1 AS unused")
    raw.write.parquet(f"{tmp_path}/all")
    loaded = load_state(spark, SourceSpec("merged", f"{tmp_path}/all"), BLENDED)
    assert loaded.wide and set(loaded.upper.columns) == {*UPPER_KEYS, "T", "u", "v", "w", "sp", "T2m", "u10", "v10"}
    plain = load_state(spark, SourceSpec("merged", f"{tmp_path}/all", time_start="2000-01-01T01", time_end="2000-01-01T03:00"))
    assert "T2m" not in plain.upper.columns
    assert plain.upper.select("time").distinct().count() == 3
    same_budget(state, loaded, BLENDED)


def test_unknown_source_kind(spark):
    with pytest.raises(ValueError, match="unsupported"):
        load_state(spark, SourceSpec("grib", "/nowhere"))


def test_written_state_reads_narrow(spark, state, tmp_path):
    write_state(state, f"{tmp_path}/s", ("sp", "T2m", "u10", "v10"))
    stored = read_state(spark, f"{tmp_path}/s")
    same_budget(state, stored, BLENDED)
    table = run_budget(stored, BoxRequest()).table()
    write_budget(table, f"{tmp_path}/b")
    assert spark.read.parquet(f"{tmp_path}/b").count() == 3


def test_appended_periods_equal_one_write(spark, state, tmp_path):
    longer = GridState(
        state.upper.unionByName(state.upper.withColumn("time", F.expr("time + interval 1 day"))),
        state.surface.unionByName(state.surface.withColumn("time", F.expr("time + interval 1 day"))),
    )
    write_state(longer, f"{tmp_path}/one")
    first = F.to_date("time") == F.lit("2000-01-01").cast("date")
    write_state(longer.restrict(first), f"{tmp_path}/two", tile_points=2)
    write_state(longer.restrict(~first), f"{tmp_path}/two", append=True)
    write_state(longer.restrict(~first), f"{tmp_path}/two", append=True)  # a day written again is replaced
    one, two = (read_state(spark, f"{tmp_path}/{name}") for name in ("one", "two"))
    assert two.tiling.lat == (40.0, 50.0, 60.0)
    one_rows, two_rows = (s.upper.drop("tile_lat", "tile_lon") for s in (one, two))
    assert one_rows.exceptAll(two_rows).isEmpty() and one_rows.count() == two_rows.count()
    assert sorted(map(tuple, one.axes.collect())) == sorted(map(tuple, two.axes.collect()))


def test_write_reads_its_input_once(spark, state, tmp_path):
    rows = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    wide = state.rows(("T", "u", "v", "w"), ("sp",))
    counted = GridState(wide.mapInArrow(seen, wide.schema), axes=coordinate_axes(wide))
    write_state(counted, f"{tmp_path}/s")
    assert rows.value == wide.count()


def test_merged_source_cuts_folders_and_compares_twins(spark, state, tmp_path):
    raw = state.rows(("T", "u", "v", "w"), ("sp",)).withColumn("date", F.to_date("time"))
    raw.withColumn("temperature", F.col("T")).write.partitionBy("date").parquet(f"{tmp_path}/m")
    loaded = load_state(spark, SourceSpec("merged", f"{tmp_path}/m", "2000-01-01T01", "2000-01-01T03"), largest={"level": 1e5, "lon": 0.0})
    filters = plan_of(loaded.upper).split("PartitionFilters: ")[1].split("]")[0]
    assert "date" in filters
    raw.withColumn("temperature", F.col("T") + 1).write.partitionBy("date").parquet(f"{tmp_path}/n")
    with pytest.raises(ValueError, match="disagree on T"):
        load_state(spark, SourceSpec("merged", f"{tmp_path}/n"))


def plan_of(df):
    """Physical plan with whole filter lists."""
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    df = df.where(F.lit(True))
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_prune_and_push(spark, state, tmp_path):
    from thermobox.operators.domain import resolve_box
    from thermobox.operators.volume import volume_moments
    from thermobox.operators.walls import wall_faces, wall_sums

    write_state(state, f"{tmp_path}/s", ("sp", "T2m", "u10", "v10"))
    stored = read_state(spark, f"{tmp_path}/s")
    box = resolve_box(stored, BoxRequest())
    volume = plan_of(volume_moments(stored, box, SurfacePolicy()))
    assert "GreaterThanOrEqual(lat,45.0)" in volume and "LessThanOrEqual(lon,-120.0)" in volume
    schema = volume.split("ReadSchema: ")[1].split("\n")[0]
    assert "u:" not in schema and "T2m" not in schema
    assert volume.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in volume and "Window" not in volume
    walls = plan_of(wall_sums(wall_faces(stored, box, BLENDED)))
    assert "In(lat" in walls and "Window" not in walls and "SortMergeJoin" not in walls
    assert "CartesianProduct" not in walls and "NestedLoop" not in walls


def test_small_box_reads_its_tiles_only(spark, tmp_path):
    """A box in the middle of a grid of 6 x 6 tiles opens the files of its own tiles, its walls those next to them."""
    from thermobox.operators.domain import resolve_box
    from thermobox.operators.walls import wall_faces

    grid = make_state(spark, level=LEVELS, lat=[float(x) for x in range(24)], lon=[float(x) for x in range(24)])
    write_state(grid, f"{tmp_path}/s", tile_points=4)
    stored = read_state(spark, f"{tmp_path}/s")
    assert len(stored.upper.inputFiles()) == 36 and stored.tiling.lat == (0.0, 4.0, 8.0, 12.0, 16.0, 20.0)
    box = resolve_box(stored, BoxRequest(bbox=(8, 13, 10, 15)))  # starts 9..11 and 11..13, in tile 2 x tiles 2 and 3

    def opened(df):
        return {tuple(part.split("=")[1] for part in name.split("/")[-3:-1]) for (name,) in df.select(F.input_file_name()).distinct().collect()}

    assert opened(box.domain(stored).upper) == {("2", "2"), ("2", "3")}
    assert opened(box.ring(stored).upper) <= {(str(i), str(j)) for i in (2, 3) for j in (2, 3)}
    filters = plan_of(box.domain(stored).upper).split("PartitionFilters: [")[1].split("]")[0]
    assert "tile_lat" in filters and "tile_lon" in filters
    same = wall_faces(grid, box, SurfacePolicy())
    assert wall_faces(stored, box, SurfacePolicy()).exceptAll(same).isEmpty()


def test_number_of_files_follows_the_data(spark, state, tmp_path):
    """Small shares of a day and tile become one file; large ones are cut."""
    write_state(state, f"{tmp_path}/one")
    assert len(read_state(spark, f"{tmp_path}/one").upper.inputFiles()) == 1
    name, before = "spark.sql.adaptive.advisoryPartitionSizeInBytes", spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set(name, "4096")
    try:
        larger = make_state(spark, level=LEVELS, lat=[float(x) for x in range(60)], lon=[float(x) for x in range(30)])
        dealt = larger.rows(("T", "u", "v", "w"), ("sp",)).repartition(8)  # a share is cut between the tasks that made it
        write_state(GridState(dealt), f"{tmp_path}/many", tile_points=100)
    finally:
        spark.conf.set(name, before)
    many = read_state(spark, f"{tmp_path}/many").upper
    assert many.select("date", "tile_lat", "tile_lon").distinct().count() == 1 and len(many.inputFiles()) > 1


def test_report_of_a_stored_state_reads_no_cell(spark, state, tmp_path):
    """Also after days were added and written again, and with a repeated and a missing point."""
    from dataclasses import replace

    upper = with_unit(state.upper, "T", "K")
    spoiled = upper.where("NOT (level = 90000 AND lat = 45 AND lon = -125)").unionByName(upper.where("level = 80000 AND lat = 40 AND lon = -130"))
    later = GridState(spoiled.withColumn("time", F.expr("time + interval 1 day")), state.surface.withColumn("time", F.expr("time + interval 1 day")))
    write_state(GridState(upper, state.surface), f"{tmp_path}/s")
    write_state(later, f"{tmp_path}/s", append=True)
    stored = read_state(spark, f"{tmp_path}/s")
    sealed = replace(stored, upper=stored.upper.withColumn("lat", F.raise_error(F.lit("a cell was read")).cast("double")))
    n = state.upper.select("time").distinct().count()
    found = {r.rule: r.n_bad for r in quality_report(sealed).collect()}
    assert (found["keys_unique"], found["grid_dense"]) == (n, n) and found == {r.rule: r.n_bad for r in quality_report(replace(stored, summary=None)).collect()}
    write_state(GridState(later.upper.where("false").unionByName(upper.withColumn("time", F.expr("time + interval 1 day"))), later.surface), f"{tmp_path}/s", append=True)
    assert all(r.ok for r in quality_report(read_state(spark, f"{tmp_path}/s")).collect() if r.rule in ("keys_unique", "grid_dense"))


def test_cells_of_an_hour_are_counted_in_hash_aggregates(spark):
    """Repeats, a last cell in a word of its own and places off the axes; no buffer of a whole bitmap an hour and task."""
    from thermobox.sources.quality import cells_per_time, read_axes

    grid = make_state(spark, level=LEVELS[:1], lat=range(5), lon=range(13), times=hours(2)).upper  # 65 cells
    axes = read_axes(GridState(grid))
    first = F.col("time") == F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    last, off = first & F.expr("lat = 4 AND lon >= 11"), ~first & F.expr("lat = 0 AND lon < 3")
    rows = grid.unionByName(grid.where(last)).unionByName(grid.where(off).withColumn("lat", F.lit(7.0))).where("NOT (lat = 1 AND lon = 1)")
    lost = grid.where(last).withColumns({"time": F.expr("time + interval 5 hours"), "level": F.lit(None).cast("double")})
    counted = cells_per_time(rows.unionByName(lost), axes, UPPER_KEYS[1:])
    assert [tuple(r)[1:] for r in counted.orderBy("time").collect()] == [(66, 64), (67, 64), (2, 0)]
    plan = plan_of(counted)
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_slice_prunes_date_folders(spark, state, tmp_path):
    write_state(state, f"{tmp_path}/s")
    sliced = slice_time(read_state(spark, f"{tmp_path}/s").upper, "2000-01-01T01", "2000-01-01T03")
    assert sliced.select("time").distinct().count() == 3
    pruned = plan_of(sliced).split("PartitionFilters: ")[1]
    assert pruned.startswith("[isnotnull(date") and "date#" in pruned.split("]")[0]


def test_kelvin_rules(spark):
    df = spark.createDataFrame([(1.0,)], "T double")
    assert to_kelvin(with_unit(df, "T", "celsius"), "T").first().T == 274.15
    assert to_kelvin(df, "T").first().T == 1.0
    assert to_kelvin(with_unit(df, "T", "Kelvin"), "T", strict=True).first().T == 1.0
    with pytest.raises(ValueError, match="no unit"):
        to_kelvin(df, "T", strict=True)
    with pytest.raises(ValueError, match="unexpected"):
        to_kelvin(with_unit(df, "T", "F"), "T", strict=True)


def raw_points(spark, points, level_unit=None):
    df = spark.createDataFrame(
        [(dt.datetime(2000, 1, 1), p, lat, lon, float("nan"), 1.0) for p, lat, lon in points],
        "time timestamp_ntz, level double, lat double, lon double, T double, u double")
    return with_unit(df, "level", level_unit) if level_unit else df


def test_harmonise_coordinates(spark):
    got = harmonise(raw_points(spark, [(1000.0, 1.0, 359.75), (850.0, 0.0, 180.0), (850.0, 0.0, 10.0)]))
    rows = {(r.level, r.lon) for r in got.collect()}
    assert rows == {(100000.0, -0.25), (85000.0, -180.0), (85000.0, 10.0)}
    assert all(r.T is None for r in got.collect())
    assert unit_of(got, "level") == "Pa"


def test_harmonise_keeps_pascal_and_signed_longitudes(spark):
    got = harmonise(raw_points(spark, [(100000.0, 0.0, 180.0), (85000.0, 0.0, -10.0)]))
    assert {(r.level, r.lon) for r in got.collect()} == {(100000.0, 180.0), (85000.0, -10.0)}
    by_unit = harmonise(raw_points(spark, [(5000.0, 0.0, 0.0)], "mbar"))
    assert by_unit.first().level == 500000.0


def test_harmonise_needs_coordinates(spark):
    with pytest.raises(ValueError, match="coordinates"):
        harmonise(spark.createDataFrame([(1.0,)], "T double"))


@pytest.mark.parametrize("start, end, want", [
    (None, None, 72), ("2000-01-02", None, 48), (None, "2000-01-01", 24), ("2000-01-01T05", "2000-01-01T05", 1),
    ("2000-01-01T05:00:00", "2000-01-01 07:00:00", 3), ("2000-01", "2000", 72), ("1999", "1999-12-31", 0),
])
def test_time_slice(spark, start, end, want):
    df = spark.createDataFrame([(t,) for t in hours(72)], "time timestamp_ntz")
    assert slice_time(df, start, end).count() == want


def test_merge_keeps_points_of_any_table(spark):
    a = spark.createDataFrame([(1, 1.0, 5.0), (2, 1.0, 6.0)], "time int, lat double, sp double")
    b = spark.createDataFrame([(2, 1.0, 7.0), (3, 1.0, 8.0)], "time int, lat double, T2m double")
    rows = {tuple(r) for r in merge_tables({"sp": a, "T2m": b}, ("time", "lat")).collect()}
    assert rows == {(1, 1.0, 5.0, None), (2, 1.0, 6.0, 7.0), (3, 1.0, None, 8.0)}
    with pytest.raises(Exception, match="two values"):
        merge_tables({"sp": a.union(a), "T2m": b}, ("time", "lat")).collect()


def test_twins_must_agree(spark):
    """Sources with one variable in common: equal, missing values included, or the job stops and the points are listed."""
    keys = ("time", "lat")
    a = spark.createDataFrame([(1, 1.0, 5.0, 1.0), (2, 1.0, None, 2.0)], "time int, lat double, sp double, T2m double")
    schema = "time int, lat double, sp double, u10 double"
    same = spark.createDataFrame([(1, 1.0, 5.0, 7.0), (2, 1.0, float("nan"), 8.0)], schema)
    short = spark.createDataFrame([(1, 1.0, 5.0, 7.0)], schema)  # lacks a point at which the other has no value either
    for b in (same, short):
        rows = {tuple(r) for r in merge_sources({"a": a, "b": b}, keys).collect()}
        assert rows == {(1, 1.0, 5.0, 1.0, 7.0), (2, 1.0, None, 2.0, 8.0 if b is same else None)}
        assert merge_clashes({"a": a, "b": b}, keys).isEmpty()
    for other, want in (([(1, 1.0, 5.5, 7.0)], (1, 1.0, "sp", 5.0, 5.5, "a,b")), ([(2, 1.0, 3.0, 7.0), (1, 1.0, 5.0, 7.0)], (2, 1.0, "sp", 3.0, 3.0, "b")),
                        ([(1, 1.0, None, 7.0)], (1, 1.0, "sp", 5.0, 5.0, "a")), ([(1, 1.0, 5.0, 7.0)] * 2, (1, 1.0, "sp", 5.0, 5.0, "a,b"))):
        b = spark.createDataFrame(other, schema)
        assert want in {tuple(r) for r in merge_clashes({"a": a, "b": b}, keys).collect()}
        with pytest.raises(Exception, match="disagree on sp"):
            merge_sources({"a": a, "b": b}, keys).collect()


def test_merge_shuffles_once(spark, state):
    sources = {"a": state.upper.select(*UPPER_KEYS, "T", "u"), "b": state.upper.select(*UPPER_KEYS, "T", "v")}
    for merged in (merge_sources(sources, UPPER_KEYS), merge_clashes(sources, UPPER_KEYS)):
        assert plan_of(merged).count("Exchange") == 1


def report(state, order=None):
    return {r.rule: r.n_bad for r in quality_report(state, order).collect()}


@pytest.fixture(scope="module")
def good(state):
    return GridState(with_unit(state.upper, "T", "K"), state.surface)


def test_good_state_passes(good):
    assert set(report(good).values()) == {0}
    assert validate(good) is good


def test_broken_states(good, spark):
    first = good.upper.where("time = '2000-01-01 00:00:00' AND level = 90000 AND lat = 45")
    assert report(GridState(good.upper.unionByName(first), good.surface))["keys_unique"] == 5
    holes = GridState(good.upper.where("NOT (time = '2000-01-01 00:00:00' AND level = 90000 AND lat = 45)"), good.surface)
    assert report(holes)["grid_dense"] == 5
    late = GridState(good.upper.where("time <> '2000-01-01 02:00:00'"), good.surface)
    assert report(late)["time_regular"] > 0
    assert report(GridState(good.upper.withColumn("T", F.col("T")).drop("w"), good.surface)) == {
        "dimensions_present": 0, "variables_present": 1}
    twice = GridState(good.upper, good.surface.unionByName(good.surface.where("lat = 45")))
    assert report(twice)["keys_unique"] == 25
    sunk = GridState(good.upper, good.surface.where("NOT (lat = 45 AND lon = -120)"))
    found = report(sunk)
    assert found["ground_dense"] == good.surface.select("time").distinct().count() and found["grid_dense"] == 0
    with pytest.raises(ValueError, match="ground_dense"):
        checked_run(sunk, BoxRequest(), BLENDED)
    celsius = GridState(with_unit(good.upper, "T", "C"), good.surface)
    assert report(celsius)["temperature_in_kelvin"] == 1
    with pytest.raises(ValueError, match="grid_dense"):
        validate(holes)


def test_source_order_rules(good):
    rising = good.upper.withColumn("row", F.col("level") * 1000 + F.col("lat"))
    bad = report(GridState(with_unit(rising, "T", "K"), good.surface), "row")
    assert bad["levels_descending"] == 3 and bad["latitudes_ascending"] == 0


def test_merged_raw_table_has_one_file_per_day(spark, tmp_path, monkeypatch):
    """Also where many tasks hold rows of every day."""
    from thermobox import catalog

    monkeypatch.setattr(catalog, "fresh_folder", lambda _, name: f"{tmp_path}/{name}")
    changed = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in changed}
    try:
        for name, value in changed.items():
            spark.conf.set(name, value)
        catalog.load_merged(spark, "/root/testdata/sf0.01")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    raw = spark.read.parquet(f"{tmp_path}/merged")
    assert len(raw.inputFiles()) == raw.select("date").distinct().count()


def test_counts_of_many_days_are_few_files(spark, tmp_path):
    """The counts kept with a stored state are one file a year, however many days it has."""
    many = make_state(spark, **GRID, times=[dt.datetime(2000, 12, 26) + dt.timedelta(hours=12 * i) for i in range(24)])
    write_state(many, f"{tmp_path}/s")
    assert len(spark.read.parquet(f"{tmp_path}/s/summary").inputFiles()) == 2
    stored = read_state(spark, f"{tmp_path}/s")
    assert stored.summary.columns == ["time", "n_rows", "n_cells"] and stored.summary.count() == 24
    assert {r.n_cells for r in stored.summary.collect()} == {100}


def test_counts_of_added_days_join_their_year(spark, tmp_path):
    many = make_state(spark, **GRID, times=[dt.datetime(2000, 3, 1) + dt.timedelta(hours=12 * i) for i in range(12)])
    late = F.col("time") >= F.lit("2000-03-03 00:00:00").cast("timestamp_ntz")
    write_state(many.restrict(~late), f"{tmp_path}/s")
    write_state(many.restrict(late), f"{tmp_path}/s", append=True)
    stored = read_state(spark, f"{tmp_path}/s")
    assert len(spark.read.parquet(f"{tmp_path}/s/summary").inputFiles()) == 1 and stored.summary.count() == 12
    assert {(r.n_rows, r.n_cells) for r in stored.summary.collect()} == {(100, 100)}


def test_small_tiles_share_a_folder_a_month(spark, tmp_path):
    """Folders of a long series of a small grid; `date` stays the day of the row, and slices read their months only."""
    many = make_state(spark, **GRID, times=[dt.datetime(2000, 1, 25) + dt.timedelta(hours=12 * i) for i in range(90)])
    write_state(many, f"{tmp_path}/s")
    upper = read_state(spark, f"{tmp_path}/s").upper
    assert len(upper.inputFiles()) == 3  # January to March, not 45 days
    assert upper.where("date <=> to_date(time)").count() == upper.count() == 9000
    assert upper.where("date = DATE'2000-02-10'").count() == 200
    sliced = slice_time(upper, "2000-02-10", "2000-02-12T00")
    assert sliced.select("time").distinct().count() == 5
    opened = {r.name.split("date=")[1][:10] for r in sliced.select(F.input_file_name().alias("name")).distinct().collect()}
    assert opened == {"2000-02-01"}
    lying = spark.read.parquet(f"{tmp_path}/s/cells")
    assert slice_time(lying, "2000-02-10", "2000-02-12T00").count() == 500


def test_large_tiles_keep_a_folder_a_day(spark, tmp_path, monkeypatch):
    from thermobox.sources import layout

    many = make_state(spark, **GRID, times=[dt.datetime(2000, 1, 30) + dt.timedelta(hours=12 * i) for i in range(8)], T=lambda t, k, i, j: 280.0 + t + k)
    write_state(many, f"{tmp_path}/months")
    monkeypatch.setattr(layout, "MONTH_ROWS", 100 * 744 - 1)
    write_state(many, f"{tmp_path}/days")
    months, days = (read_state(spark, f"{tmp_path}/{name}") for name in ("months", "days"))
    assert len(months.upper.inputFiles()) == 2 and len(days.upper.inputFiles()) == 4
    assert (months.tiling.monthly, days.tiling.monthly) == (True, False) and "since" not in days.upper.columns
    assert months.upper.drop("since").select(days.upper.columns).exceptAll(days.upper).isEmpty()
    same_budget(months, days)


def test_coordinates_come_from_the_keys_of_the_variables(spark, state, tmp_path):
    """Without merging them; also a point that one variable alone has, and after a slice."""
    tables = raw_tables(state)
    tables["w"] = tables["w"].unionByName(tables["w"].where("hour(valid_time) = 2").limit(1).withColumn("latitude", F.lit(77.0)))
    for name, table in tables.items():
        table.write.parquet(f"{tmp_path}/{VARIABLE_FILES[name][0]}.parquet")
    source = SourceSpec("per_variable", str(tmp_path), "2000-01-01T01", None, units={"T": "C", "T2m": "K"})
    loaded = load_state(spark, source, coordinates=True)
    assert load_state(spark, source).axes is None
    assert plan_of(loaded.axes).count("Exchange") == 1 and not loaded.axes.where("axis = 'lat' AND value = 77").isEmpty()
    assert sorted(map(tuple, loaded.axes.collect())) == sorted(map(tuple, coordinate_axes(loaded.upper).collect()))


def test_added_days_join_their_month(spark, tmp_path):
    """Days of a month that are written again are replaced, tile by tile; the other days of their folders stay."""
    times = [dt.datetime(2000, 1, 30) + dt.timedelta(hours=12 * i) for i in range(12)]
    first = make_state(spark, **GRID, times=times, T=lambda t, k, i, j: 280.0 + t)
    second = make_state(spark, **GRID, times=times, T=lambda t, k, i, j: 290.0 + t)
    early = F.col("time") < F.lit("2000-02-03 00:00:00").cast("timestamp_ntz")
    again = (F.to_date("time") == F.lit("2000-02-01").cast("date")) & (F.col("lat") >= 50)
    write_state(first.restrict(early), f"{tmp_path}/s", tile_points=2)
    write_state(first.restrict(~early), f"{tmp_path}/s", append=True)
    write_state(second.restrict(again), f"{tmp_path}/s", append=True)
    stored = read_state(spark, f"{tmp_path}/s")
    wanted = first.restrict(~again).rows(("T",), ("sp",)).unionByName(second.restrict(again).rows(("T",), ("sp",)))
    found = stored.upper.select(*wanted.columns)
    assert stored.upper.select("since").distinct().count() == 2 and found.count() == wanted.count() == 1200
    assert found.exceptAll(wanted).isEmpty()
    assert {(r.n_rows, r.n_cells) for r in stored.summary.collect()} == {(100, 100)} and stored.summary.count() == 12
