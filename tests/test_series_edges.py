"""Edge rules of the hourly series operators, each on a few literal rows."""

import datetime as dt

import pandas as pd
import pytest

from floodlake.operators import events, features as feat, grid, spatial, stats

T0 = dt.datetime(2024, 1, 1)


def hours(n, start=T0):
    return [start + dt.timedelta(hours=i) for i in range(n)]


def series(spark, values, basin=0):
    rows = [(basin, h, float(v) if v is not None else None) for h, v in zip(hours(len(values)), values)]
    return spark.createDataFrame(rows, "basin_id int, hour timestamp_ntz, flow double")


def test_exact_seven_day_gap_stays_in_event(spark):
    t = [T0, T0 + dt.timedelta(days=7)]
    df = spark.createDataFrame([(0, x, 30.0) for x in t], "basin_id int, hour timestamp_ntz, flow double")
    assert {r.event_id for r in events.flood_sessions(df, 10.0).collect()} == {0}
    t2 = [T0, T0 + dt.timedelta(days=7, seconds=1)]
    df2 = spark.createDataFrame([(0, x, 30.0) for x in t2], "basin_id int, hour timestamp_ntz, flow double")
    assert sorted(r.event_id for r in events.flood_sessions(df2, 10.0).collect()) == [0, 1]


def test_series_starting_above_threshold(spark):
    out = events.threshold_sweep(series(spark, [9, 1, 9, 9, 1]), [5]).collect()[0]
    assert (out.events, out.hours_above) == (1, 3)


def test_future_label_tail_is_zero(spark):
    out = events.label_ahead(series(spark, [1, 20]), 10.0, 1).orderBy("hour").collect()
    assert [r.flood_in_1h for r in out] == [1, 0]


def test_active_flag_after_null_is_zero(spark):
    df = feat.flow_features(series(spark, [5, None, 5]))
    assert [r.Flow_Is_Active for r in df.orderBy("hour").collect()] == [0, 1, 0]


def test_nulled_flow_removes_dependent_rows(spark):
    vals = [1.0] * 200
    vals[100] = None
    df = feat.flow_features(series(spark, vals))
    bad = {i for i, r in enumerate(df.orderBy("hour").collect())
           if any(r[c] is None for c in feat.FLOW_FEATURES + ["flow"])}
    assert bad - set(range(25)) == {100, 101, 102, 103, 106, 112, 124}


def test_rolling_guard(spark):
    df = series(spark, [1.0] * 400).withColumnRenamed("flow", "Basin_Rain_Mean")
    r = df.select("hour", feat.rolling_sum("Basin_Rain_Mean", 168, 1).alias("s")).orderBy("hour").collect()
    first = next(i for i, x in enumerate(r) if x.s is not None)
    assert first == 168 and r[first].s == 168.0


def test_hourly_gap_filled_with_zero(spark):
    times = [T0 + dt.timedelta(minutes=10 * i) for i in range(6)] + [T0 + dt.timedelta(hours=3, minutes=m)
                                                                     for m in (0, 10)]
    rows = [(0, 0, t, float(v)) for t, v in zip(times, range(1, 9))]
    df = spark.createDataFrame(rows, "basin_id int, station_id int, measurement_time timestamp_ntz, "
                                     "rain_amount_mm double")
    out = grid.hourly_rain(df).orderBy("hour").collect()
    assert [r.hourly_rain_sum for r in out] == [21.0, 0.0, 0.0, 15.0]
    assert [r.max_10min_intensity for r in out] == [6.0, 0.0, 0.0, 8.0]


def test_forward_fill_leading_gap(spark):
    rows = [(0, T0 + dt.timedelta(minutes=5), None), (0, T0 + dt.timedelta(hours=1), 3.0),
            (0, T0 + dt.timedelta(hours=3), 1.0)]
    df = spark.createDataFrame(rows, "basin_id int, measurement_time timestamp_ntz, flow double")
    assert [r.flow for r in grid.hourly_flow(df).orderBy("hour").collect()] == [0.0, 3.0, 3.0, 1.0]


def test_single_station_std_zero_and_absent_stations(spark):
    rows = [(0, 0, T0, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "basin_id int, station_id int, hour timestamp_ntz, hourly_rain_sum double, "
                                     "max_10min_intensity double")
    r = spatial.basin_stats(df).collect()[0]
    assert r.Basin_Rain_Std == 0.0 and r.Basin_Rain_Mean == 2.0
    rows = [(0, 0, T0, 3.0, 1.0), (0, 1, T0 + dt.timedelta(hours=1), 6.0, 2.0), (0, 2, T0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "basin_id int, station_id int, hour timestamp_ntz, hourly_rain_sum double, "
                                     "max_10min_intensity double")
    got = {r.hour: r for r in spatial.basin_stats(df).collect()}
    dense = pd.DataFrame({"x": [3.0, 0.0, 0.0]})
    assert got[T0].Basin_Rain_Mean == pytest.approx(1.0)
    assert got[T0].Basin_Rain_Std == pytest.approx(dense.x.std())
    assert got[T0 + dt.timedelta(hours=1)].Basin_Rain_Max == 6.0
    assert got[T0 + dt.timedelta(hours=1)].Basin_Rain_Count == 1


def test_percentile_linear(spark):
    df = series(spark, list(range(1, 11)))
    r = stats.flow_distribution(df).collect()[0]
    assert r.p95_flow == pytest.approx(9.55) and r.median_flow == pytest.approx(5.5)


def test_event_cut_with_few_events(spark):
    ev = spark.createDataFrame([(0, 0, T0), (0, 1, T0 + dt.timedelta(days=30))],
                               "basin_id int, event_id int, end_time timestamp_ntz")
    r = events.event_cutoff(ev).collect()[0]
    assert r.cutoff_event is None and r.cutoff_time is None and r.n_test_events == 2
    many = spark.createDataFrame([(0, i, T0 + dt.timedelta(days=10 * i)) for i in range(12)],
                                 "basin_id int, event_id int, end_time timestamp_ntz")
    r = events.event_cutoff(many).collect()[0]
    assert (r.n_test_events, r.cutoff_event) == (2, 9)
    assert r.cutoff_time == T0 + dt.timedelta(days=90)


def test_peak_hydrograph_first_of_ties(spark):
    df = series(spark, [1, 9, 3] + [0] * 100 + [9])
    rows = events.peak_hydrograph(df, days=2).collect()
    assert {r.peak_time for r in rows} == {T0 + dt.timedelta(hours=1)}
    assert len(rows) == 50  # hours 0..49 lie within +-48 hours of hour 1


def test_row_split_floor(spark):
    out = events.row_split(series(spark, list(range(11)))).orderBy("hour").collect()
    assert [r.split for r in out].count("train") == 8


def test_label_ahead_time_aligned_skips_missing_hour(spark):
    rows = [(0, T0, 1.0), (0, T0 + dt.timedelta(hours=1), 20.0), (0, T0 + dt.timedelta(hours=3), 30.0),
            (0, T0 + dt.timedelta(hours=4), 1.0)]
    df = spark.createDataFrame(rows, "basin_id int, hour timestamp_ntz, flow double")
    by_row = [r.flood_in_1h for r in events.label_ahead(df, 10.0, 1).orderBy("hour").collect()]
    by_time = [r.flood_in_1h for r in events.label_ahead(df, 10.0, 1, align="time").orderBy("hour").collect()]
    assert by_row == [1, 1, 0, 0]       # the row after hour 1 is hour 3 (a removed gap)
    assert by_time == [1, 0, 0, 0]      # hour 2 does not exist: no label from hour 3


def test_hour_grid_dense(spark):
    rows = [(0, T0), (0, T0 + dt.timedelta(hours=5)), (1, T0 + dt.timedelta(hours=2))]
    df = spark.createDataFrame(rows, "basin_id int, hour timestamp_ntz")
    got = {(r.basin_id, r.hour) for r in grid.hour_grid(df, ["basin_id"]).collect()}
    assert got == {(0, T0 + dt.timedelta(hours=i)) for i in range(6)} | {(1, T0 + dt.timedelta(hours=2))}


def test_flow_distribution_approx_option(spark):
    df = series(spark, list(range(1, 1001)))
    exact = stats.flow_distribution(df).collect()[0]
    approx = stats.flow_distribution(df, approx=True).collect()[0]
    assert exact.median_flow == pytest.approx(500.5)
    assert abs(approx.median_flow - exact.median_flow) <= 1.0
    assert abs(approx.p99_flow - exact.p99_flow) <= 1.0 and approx.max_flow == exact.max_flow
