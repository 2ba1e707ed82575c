"""Live-cycle operators and the forecast update."""

import datetime as dt

from pyspark.sql import functions as F

from floodlake.operators import forecast, live
from floodlake.sources import dims

T = dt.datetime(2024, 1, 1, 12)


def test_last_hour_takes_then_filters(spark):
    rows = [(1, T + dt.timedelta(minutes=10 * i), float(i), 1 if i != 7 else 2) for i in range(8)]
    rows.append((1, T + dt.timedelta(minutes=5), -9999.0, 1))     # old sentinel, not among the last six
    df = spark.createDataFrame(rows, "station_id int, measurement_time timestamp_ntz, rain_amount_mm double, status int")
    r = live.last_hour_rain(df, ["station_id"], "measurement_time").collect()[0]
    assert r.last_hour_rain == 2 + 3 + 4 + 5 + 6 and r.n_taken == 6


def test_upsert_is_idempotent(spark):
    stations = spark.createDataFrame([(1,)], "station_id int")
    batch = spark.createDataFrame([(1, 1, T, 1.0), (2, 1, T, 2.0), (3, 9, T, 3.0), (4, 1, T + dt.timedelta(hours=1), 4.0)],
                                  "event_id long, station_id int, measurement_time timestamp_ntz, rain_amount_mm double")
    target = spark.createDataFrame([(1, T + dt.timedelta(hours=1))], "station_id int, measurement_time timestamp_ntz")
    out = live.upsert_new(batch.withColumn("status", F.lit(1)), target, stations).collect()
    assert [(r.event_id, r.region_id, r.status) for r in out] == [(1, None, 1)]


def test_update_prefers_best_then_nearest_then_smallest_id(spark):
    st = spark.createDataFrame([(10, "A"), (11, "B")], "settlement_id int, name_eng string")
    matched = spark.createDataFrame(
        [(10, 80, 2.0, 5, 1.0, 1.0), (10, 80, 1.0, 6, 2.0, 2.0), (10, 80, 1.0, 4, 3.0, 3.0), (10, 70, 0.1, 1, 9.0, 9.0)],
        "settlement_id int, score int, distance_km double, ims_id long, current_rain double, next_rain double")
    out = {r.settlement_id: r for r in forecast.update_forecasts(st, matched).collect()}
    assert out[10].current_6h_forecast == 3.0 and out[11].current_6h_forecast is None


def test_forecast_pick_last_duplicate_and_missing(spark):
    rows = [(1, dt.datetime(2024, 1, 1, 9), 1, 1.0), (1, dt.datetime(2024, 1, 1, 9), 2, None),
            (1, dt.datetime(2024, 1, 1, 15), 3, 4.0), (2, dt.datetime(2024, 1, 1, 3), 4, 7.0)]
    fc = spark.createDataFrame(rows, "location_id int, forecast_time timestamp_ntz, pos long, rain double")
    out = {r.location_id: r for r in forecast.forecast_pick(fc, "2024-01-01 10:00:00").collect()}
    assert (out[1].current_rain, out[1].next_rain) == (0.0, 4.0)
    assert (out[2].current_rain, out[2].next_rain) == (0.0, 0.0)


def test_feed_peaks_and_routing(spark):
    feed = spark.createDataFrame(
        [(1, dims.escape_unicode("שורק-יבנה"), [("", "d", "t"), ("3.5", "01/01", "10:00")]),
         (2, "שורק-יסודות", [("3.5", "02/01", "11:00")]),
         (3, "צלמון", [(None, "d", "t"), ("1.0", None, "09:00")]),
         (4, "unknown", [("99", "d", "t")])],
        "feed_id long, name string, obs array<struct<flow:string,date:string,time:string>>")
    first = live.first_valid_obs(feed)
    peaks = {r.sub_basin: r for r in live.basin_peak_flow(first, dims.feed_names(spark)).collect()}
    assert peaks["Sorek - lower"].last_updated == "01/01 10:00"       # equal flows: earlier station wins
    assert peaks["Tzalmon"].last_updated is None
    routed = {r.sub_basin: r.model_basin for r in live.route_basin(
        live.basin_peak_flow(first, dims.feed_names(spark)), dims.routing(spark)).collect()}
    assert routed == {"Sorek - lower": "Sorek", "Tzalmon": None}


def test_dimension_sizes(spark):
    assert dims.feed_names(spark).count() == 64
    assert dims.routing(spark).count() == 129
