"""The hourly live cycle and the matching job over landed files."""

import json

from pyspark.sql import functions as F

from floodlake.plans import live, matching

FORECAST = """<LocationForecasts>
 <Location><LocationMetaData><LocationId>1</LocationId><LocationNameEng>Kfar Nahum</LocationNameEng>
   <DisplayLat>32.880</DisplayLat><DisplayLon>35.575</DisplayLon></LocationMetaData>
   <LocationData>
     <Forecast><ForecastTime>2024-01-01 09:00:00</ForecastTime><Rain>1.5</Rain></Forecast>
     <Forecast><ForecastTime>2024-01-01 15:00:00</ForecastTime><Rain>4.0</Rain></Forecast>
   </LocationData></Location>
 <Location><LocationMetaData><LocationId>2</LocationId><LocationNameEng>Nowhere</LocationNameEng>
   <DisplayLat></DisplayLat><DisplayLon>35.0</DisplayLon></LocationMetaData></Location>
 <Location><LocationMetaData><LocationId>1</LocationId><LocationNameEng>Kfar Nahum</LocationNameEng>
   <DisplayLat>32.880</DisplayLat><DisplayLon>35.575</DisplayLon></LocationMetaData>
   <LocationData><Forecast><ForecastTime>2024-01-01 09:00:00</ForecastTime><Rain>2.5</Rain></Forecast>
   </LocationData></Location>
</LocationForecasts>"""


def test_live_cycle(spark, tmp_path):
    catalog = [{"stationId": 1, "name": "North", "regionId": 3, "monitors": [{"channelId": 7, "name": "Rain"}]},
               {"stationId": 2, "name": "South", "regionId": 4, "monitors": [{"channelId": 2, "name": "Rain"}]},
               {"stationId": 3, "name": "Dry", "regionId": 4, "monitors": [{"channelId": 1, "name": "TD"}]}]
    (tmp_path / "catalog.json").write_text(json.dumps(catalog))
    latest = [{"stationId": 1, "data": [{"datetime": "2024-01-01T10:10:00", "channels": [{"value": 6.5, "status": 1}]}]},
              {"stationId": 2, "data": []},
              {"stationId": 3, "data": [{"datetime": "2024-01-01T10:10:00", "channels": [{"value": 9.0, "status": 1}]}]}]
    (tmp_path / "latest.jsonl").write_text("\n".join(json.dumps(x) for x in latest))
    registry = spark.createDataFrame([(1,), (2,)], "station_id int")
    store = str(tmp_path / "rain_measurements")
    args = (spark, str(tmp_path / "catalog.json"), str(tmp_path / "latest.jsonl"), registry, store)
    assert live.sync_rain(*args) == 1
    assert live.sync_rain(*args) == 0          # rerun of the same hour stores nothing twice
    lines = [r.line for r in live.rain_alerts(spark, store).orderBy(F.col("sort_key").asc_nulls_first()).collect()]
    assert lines == ["Found 1 records exceeding 5.0mm:", "- Station 'North' at 2024-01-01 10:10:00: 6.5mm"]


def test_matching_then_forecast_update(spark, tmp_path):
    (tmp_path / "forecast.xml").write_text(FORECAST)
    settlements = spark.createDataFrame([(1252, "Korazim", 32.91, 35.56), (9, "Far", 31.0, 34.8)],
                                        "settlement_id long, name_eng string, lat double, lon double")
    review = str(tmp_path / "review")
    m = {r.ims_id: r for r in matching.match_locations(spark, str(tmp_path / "forecast.xml"), settlements,
                                                         review).collect()}
    assert m[1].matched_id == 1252.0 and m[1].score == 47 and m[2].matched_name == "NO MATCH FOUND"
    header = spark.read.text(review).first()[0]
    assert header.removeprefix("\ufeff").startswith("IMS_ID,IMS_Name,Matched_DB_ID")
    out = live.update_settlement_forecasts(spark, str(tmp_path / "forecast.xml"), review,
                                           settlements.select("settlement_id", "name_eng"), "2024-01-01 10:00:00")
    got = {r.settlement_id: (r.current_6h_forecast, r.next_6h_forecast) for r in out.collect()}
    assert got[1252] == (2.5, 4.0)      # the later Location element overrides 09:00
    assert got[9] == (None, None)


def test_monthly_and_daily_reads(spark, tmp_path):
    from floodlake.operators.live import last_hour_of_series
    from floodlake.sources import feeds
    entry = lambda k, value, status=1: {"datetime": f"2026-02-01T10:{k:02d}:00",
                                        "channels": [{"value": value, "status": status}]}
    landed = [{"stationId": 1, "data": [entry(50 - k, float(k)) for k in range(8)]},      # feed order, not time order
              {"stationId": 2, "data": []}, {"stationId": 3},
              {"stationId": 4, "data": [entry(0, -9999.0), entry(1, 2.0, 2), entry(2, None), {"datetime": "2026-02-01T10:03:00"}]}]
    (tmp_path / "d.jsonl").write_text("\n".join(json.dumps(x) for x in landed))
    path = str(tmp_path / "d.jsonl")
    got = {r.station_id: (r.last_hour_rain, r.n_taken) for r in last_hour_of_series(feeds.read_daily(spark, path)).collect()}
    assert got == {1: (2.0 + 3 + 4 + 5 + 6 + 7, 6), 2: (0.0, 0), 3: (0.0, 0), 4: (-9999.0, 4)}
    monthly = feeds.read_monthly(spark, path)
    assert monthly.columns == ["station_id", "measurement_time", "rain_amount_mm", "status"]
    assert sorted(r.rain_amount_mm for r in monthly.collect()) == [float(k) for k in range(8)]


def test_settlements_read(spark, tmp_path):
    from floodlake.sources import files
    cols = "name_heb string, settlement_id long, extra int, lat double, name_eng string, lon double"
    spark.createDataFrame([("x", 5, 1, 31.0, "Y", 35.0)], cols).write.parquet(str(tmp_path / "s"))
    df = files.read_settlements(spark, str(tmp_path / "s"))
    assert df.collect() == [(5, "Y", "x", 31.0, 35.0)]
    assert "extra" not in df._jdf.queryExecution().executedPlan().toString()


def test_digests_come_out_in_order(spark):
    from floodlake.operators import alerts
    items = spark.createDataFrame([(10, "Red - b", "d"), (2, "Red - a", "c")],
                                  "item_id long, title_clean string, details string")
    assert [r.sort_key for r in alerts.warnings_digest(items, "07/04/2026").collect()] == [None, 2, 10]
    assert [r.block for r in alerts.warnings_list(items).collect()] == [
        "Active IMS Warnings found:", "- Title: Red - a\n  Details: c\n", "- Title: Red - b\n  Details: d\n"]
    assert [r.block for r in alerts.warnings_list(items.limit(0)).collect()] == [alerts.WARNINGS_NONE]
    rows = spark.createDataFrame([("A", 6.0), ("B", 11.0)], "station_name string, rain_amount_mm double").selectExpr(
        "*", "timestamp_ntz '2024-01-01 00:00:00' AS measurement_time")
    assert [r.sort_key for r in alerts.alert_digest(rows, 5.0).collect()] == [None, 11.0, 6.0]


def test_warnings_digest_from_feed(spark, tmp_path):
    rss = """<rss><channel><item><title>Orange warning - flash floods</title>
      <description>&lt;p style='padding-bottom:30px;'&gt;Regions: Southern Negev. Timeframe: 12:00 to 20:00 LT&lt;/p&gt;</description>
      </item></channel></rss>"""
    (tmp_path / "w.xml").write_text(rss)
    rows = live.warnings_digest(spark, str(tmp_path / "w.xml"), "07/04/2026").orderBy(
        F.col("sort_key").asc_nulls_first()).collect()
    assert [r.block for r in rows] == ["# 07/04/2026",
                                       "## Orange - Flash Floods\nRegions: Southern Negev\nTimeframe: 12:00 to 20:00 LT"]
