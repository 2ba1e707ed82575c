"""Sinks write committed parquet/CSV folders; the insert is idempotent."""

import datetime as dt

from pyspark.sql import functions as F

from floodlake import sinks
from floodlake.sources import files

T = dt.datetime(2024, 1, 1)


def test_insert_new_twice_inserts_once(spark, tmp_path):
    stations = spark.createDataFrame([(1,), (2,)], "station_id int")
    batch = spark.createDataFrame(
        [(1, 1, T, 0.5, 1), (2, 1, T, 0.7, 1), (3, 2, T, 1.0, 1), (4, 9, T, 2.0, 1)],
        "event_id long, station_id int, measurement_time timestamp_ntz, rain_amount_mm double, status int")
    path = str(tmp_path / "rain_measurements")
    assert sinks.insert_new(batch, path, stations) == 2
    assert sinks.insert_new(batch, path, stations) == 0
    rows = spark.read.parquet(path).orderBy("station_id").collect()
    assert [(r.station_id, r.rain_amount_mm) for r in rows] == [(1, 0.5), (2, 1.0)]


def test_grid_and_review_outputs(spark, tmp_path):
    df = spark.createDataFrame([(0, T, 1.0), (1, T, 2.0)], "basin_id int, hour timestamp_ntz, flow double")
    sinks.write_grid(df, str(tmp_path / "grid"))
    assert spark.read.parquet(str(tmp_path / "grid")).filter(F.col("basin_id") == 1).count() == 1
    m = spark.createDataFrame([(1, "a", 2.0, "b", 1.0, 80), (2, "c", None, "NO MATCH FOUND", None, 0)],
                              "ims_id long, ims_name string, matched_id double, matched_name string, "
                              "distance_km double, score int")
    sinks.write_review(m, str(tmp_path / "review"))
    back = spark.read.option("header", True).csv(str(tmp_path / "review")).collect()
    assert back[0].Matched_DB_Name == "NO MATCH FOUND"
    part = next((tmp_path / "review").glob("part-*.csv"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbfIMS_ID,")      # spreadsheets look for the mark
    assert {r.ims_id for r in files.read_mapping(spark, str(tmp_path / "review")).collect()} == {1, 2}


def test_hourly_files_station_from_name(spark, tmp_path):
    for st in ("Jerusalem_Center", "Bet_Jamal"):
        (tmp_path / f"{st}_Hourly_Rain_Features.csv").write_text(
            "DateTime,Hourly_Rain_Sum,Max_10min_Intensity\n2020-01-01 00:00:00,1.5,0.5\n2020-01-01 01:00:00,0,0\n")
    df = files.read_hourly(spark, [str(p) for p in sorted(tmp_path.glob("*.csv"))])
    got = {(r.station_id, r.Rain) for r in df.collect()}
    assert got == {("Bet_Jamal", 1.5), ("Bet_Jamal", 0.0), ("Jerusalem_Center", 1.5), ("Jerusalem_Center", 0.0)}


def test_insert_reads_only_batch_days(spark, tmp_path):
    stations = spark.createDataFrame([(1,)], "station_id int")
    old = spark.createDataFrame([(i, 1, T + dt.timedelta(days=i), 1.0, 1) for i in range(10)],
                                "event_id long, station_id int, measurement_time timestamp_ntz, "
                                "rain_amount_mm double, status int")
    path = str(tmp_path / "t")
    assert sinks.insert_new(old, path, stations) == 10
    batch = old.filter(F.col("event_id") == 3).unionByName(
        spark.createDataFrame([(99, 1, T + dt.timedelta(days=3, hours=1), 2.0, 1)], old.schema))
    assert sinks.insert_new(batch, path, stations) == 1
    # the anti-join prunes the stored table to the batch's day
    from floodlake.operators.live import upsert_new
    target = spark.read.parquet(path)
    plan = upsert_new(batch.withColumn("day", F.to_date("measurement_time")), target, stations,
                      ["station_id", "measurement_time", "day"], prune_by="day")
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in text.lower()
