"""Physical-plan guards: the raw readings are scanned once and the quality filter
reaches the parquet scan (the no-Cartesian guard runs in the oracle sweep)."""

import datetime as dt

import pytest

from floodlake.operators import grid, quality


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hourly_grid_scans_raw_once_with_pushdown(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i % 3, i % 6, t0 + dt.timedelta(minutes=10 * i), float(i % 5), 1 + (i % 7 == 0)) for i in range(500)]
    raw = spark.createDataFrame(rows, "basin_id int, station_id int, measurement_time timestamp_ntz, "
                                      "rain_amount_mm double, status int")
    path = str(tmp_path / "rain")
    raw.write.parquet(path)
    df = grid.hourly_rain(quality.quality_filter(spark.read.parquet(path)))
    plan = final_plan(df)
    final = plan.split("Initial Plan")[0]
    assert final.count("FileScan parquet") == 1
    assert "PushedFilters: [IsNotNull(rain_amount_mm), IsNotNull(status), GreaterThanOrEqual(rain_amount_mm,0.0)" in final


def test_hot_station_is_combined_before_the_shuffle(spark):
    t0 = dt.datetime(2024, 1, 1)
    # station 0 holds ~90% of the readings
    rows = [(0, 0 if i % 10 else 1 + i % 3, t0 + dt.timedelta(minutes=i), 1.0, 1) for i in range(3000)]
    raw = spark.createDataFrame(rows, "basin_id int, station_id int, measurement_time timestamp_ntz, "
                                      "rain_amount_mm double, status int")
    df = grid.hourly_rain(raw)
    plan = final_plan(df).split("Initial Plan")[0]
    # partial sums/maxima are computed per task before rows are exchanged
    assert "partial_sum" in plan and "partial_max" in plan
    first = plan.index("partial_sum")
    assert "Exchange hashpartitioning(basin_id" in plan[:first] or "ShuffleQueryStage" in plan[:first]
    assert df.filter("station_id = 0").count() == 50   # 3000 minutes -> 50 hours, no gap


def test_configured_stations_single_scan(spark, tmp_path):
    from floodlake.operators import spatial
    t0 = dt.datetime(2024, 1, 1)
    rows = [(0, s, t0 + dt.timedelta(minutes=20 * i), float(i % 4), 1) for s in (1, 2) for i in range(30)]
    raw = spark.createDataFrame(rows, "basin_id int, station_id int, measurement_time timestamp_ntz, "
                                      "rain_amount_mm double, status int")
    path = str(tmp_path / "rain")
    raw.write.parquet(path)
    # station 3 is configured for the basin but has no readings: it counts as zeros
    stations = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "basin_id int, station_id int")
    stats = spatial.basin_stats(grid.hourly_rain(spark.read.parquet(path)), stations=stations)
    plan = final_plan(stats).split("Initial Plan")[0]
    assert plan.count("FileScan parquet") == 1
    first = stats.orderBy("hour").first()
    # hour 0: both stations read 0+1+2 = 3 -> mean over 3 configured stations = 2.0
    assert first.Basin_Rain_Mean == pytest.approx(2.0) and first.Basin_Rain_Count == 2
