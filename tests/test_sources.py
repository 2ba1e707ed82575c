"""File sources read from small files written to a scratch folder."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from floodlake.functions.timecols import RAIN_TIME_PATTERNS, forecast_windows, parse_number, parse_time
from floodlake.sources import feeds, files


def write(path, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding) as fh:
        fh.write(text)


def test_station_catalog_first_rain_channel(spark, tmp_path):
    cat = [
        {"stationId": 1, "name": "A", "regionId": 7,
         "monitors": [{"channelId": 3, "name": "TD"}, {"channelId": 5, "name": "Rain"}, {"channelId": 6, "name": "Rain"}]},
        {"stationId": 2, "name": "B", "regionId": 7, "monitors": [{"channelId": 0, "name": "Rain"}]},
        {"stationId": 3, "name": "C", "regionId": 7},
        {"stationId": 4, "name": "D", "regionId": None, "monitors": [{"channelId": 9, "name": "WS"}]},
    ]
    write(str(tmp_path / "stations.json"), json.dumps(cat))
    out = feeds.read_stations(spark, str(tmp_path / "stations.json")).collect()
    assert [(r.station_id, r.channel_id) for r in out] == [(1, 5)]


def test_rss_items_at_any_depth(spark, tmp_path):
    rss = """<rss><channel><title>feed</title>
      <item><title>Yellow warning - flash floods</title>
        <description>&lt;p style='padding-bottom:30px;'&gt;Regions: Dead Sea. Timeframe: 10:00 to 22:00 LT&lt;/p&gt;</description>
      </item>
      <item><description>x</description></item>
    </channel></rss>"""
    write(str(tmp_path / "w.xml"), rss)
    out = feeds.read_warnings(spark, str(tmp_path / "w.xml")).orderBy("title_clean").collect()
    assert [r.title_clean for r in out] == ["No Title", "Yellow warning - flash floods"]
    assert out[1].details == "Regions: Dead Sea. Timeframe: 10:00 to 22:00 LT"


def test_forecast_xml_missing_nodes(spark, tmp_path):
    xml = """<LocationForecasts>
      <Location><LocationMetaData><LocationId>1</LocationId><LocationNameEng>A</LocationNameEng>
        <DisplayLat>31.1</DisplayLat><DisplayLon></DisplayLon></LocationMetaData>
        <LocationData>
          <Forecast><ForecastTime>2024-01-01 09:00:00</ForecastTime><Rain>1.5</Rain></Forecast>
          <Forecast><ForecastTime>2024-01-01 15:00:00</ForecastTime><Rain/></Forecast>
        </LocationData></Location>
      <Location><LocationMetaData><LocationId>2</LocationId><LocationNameEng>B</LocationNameEng>
        <DisplayLat>abc</DisplayLat><DisplayLon>35.0</DisplayLon></LocationMetaData></Location>
    </LocationForecasts>"""
    write(str(tmp_path / "f.xml"), xml)
    rows = feeds.read_forecast(spark, str(tmp_path / "f.xml")).orderBy("location_id", "pos").collect()
    assert [(r.location_id, r.rain) for r in rows] == [("1", 1.5), ("1", 0.0), ("2", 0.0)]
    raw = spark.read.format("xml").option("rowTag", "Location").schema(feeds.FORECAST_LOCATION).load(str(tmp_path / "f.xml"))
    coords = feeds.location_coords(raw.select(F.struct(*raw.columns).alias("loc"))).orderBy("ims_id").collect()
    assert (coords[0].lat, coords[0].lon) == (31.1, None)      # empty text: NULL on its own
    assert (coords[1].lat, coords[1].lon) == (None, None)      # unparsable: both NULL


def test_rain_csv_files_and_station_name(spark, tmp_path):
    a = "Station,DateTime,Rainfall\nX,01/02/2020 10:00,0.5\nX,31/02/2020 10:00,1\nX,1/2/2020 10:10,abc\n"
    b = "Station,DateTime,Rainfall\nX,01/02/2020 10:00,0.5\n"
    write(str(tmp_path / "jerusalem_center_2010_2018.csv"), a)
    write(str(tmp_path / "jerusalem_center_2018_2019.csv"), b)
    out = files.read_rain_csv(spark, [str(tmp_path / "jerusalem_center_2010_2018.csv"),
                                      str(tmp_path / "jerusalem_center_2018_2019.csv")]).collect()
    assert sorted(r.rainfall for r in out) == [0.0, 0.5, 0.5]     # bad date dropped, bad number -> 0, dup kept
    assert {r.station_name for r in out} == {"Jerusalem Center"}


def test_mapping_csv_with_bom(spark, tmp_path):
    text = "IMS_ID,IMS_Name,Matched_DB_ID,Matched_DB_Name,Distance_KM,Confidence_Score\n" \
           "213,Kfar Nahum,1252.0,Korazim,4.0,47\n257,Qasr,,NO MATCH FOUND,,0\n"
    write(str(tmp_path / "m.csv"), text, encoding="utf-8-sig")
    out = files.read_mapping(spark, str(tmp_path / "m.csv")).orderBy("ims_id").collect()
    assert out[0].ims_id == 213 and out[0].matched_id == 1252.0 and out[1].matched_id is None


def test_parse_under_ansi(spark):
    df = spark.createDataFrame([("abc", "31/02/2020 10:00"), ("2.5", "5/3/2020 7:05")], "n string, t string")
    rows = df.select(parse_number(F.col("n")).alias("n"), parse_time(F.col("t"), RAIN_TIME_PATTERNS).alias("t")).collect()
    assert rows[0].n == 0.0 and rows[0].t is None
    assert rows[1].n == 2.5 and rows[1].t == dt.datetime(2020, 3, 5, 7, 5)


def test_forecast_windows(spark):
    cases = {dt.datetime(2024, 1, 2, 2, 59): (dt.datetime(2024, 1, 1, 21), dt.datetime(2024, 1, 2, 3)),
             dt.datetime(2024, 1, 2, 3, 0): (dt.datetime(2024, 1, 2, 3), dt.datetime(2024, 1, 2, 9)),
             dt.datetime(2024, 1, 2, 21, 30): (dt.datetime(2024, 1, 2, 21), dt.datetime(2024, 1, 3, 3)),
             dt.datetime(2024, 1, 2, 14, 0): (dt.datetime(2024, 1, 2, 9), dt.datetime(2024, 1, 2, 15))}
    df = spark.createDataFrame([(k,) for k in cases], "t timestamp_ntz")
    cur, nxt = forecast_windows(F.col("t"))
    for r in df.select("t", cur.alias("c"), nxt.alias("n")).collect():
        assert (r.c, r.n) == cases[r.t]


def test_readme_file_calls(spark, tmp_path):
    from floodlake.operators import grid
    write(str(tmp_path / "hefez_hayim_2010_2018.csv"),
          "Station,DateTime,Rainfall\nH,01/02/2020 10:00,0.5\nH,01/02/2020 10:10,1.5\nH,01/02/2020 12:00,2\n")
    rain = files.read_rain_csv(spark, [str(tmp_path / "hefez_hayim_2010_2018.csv")])
    hr = grid.hourly_rain(rain, keys=["station_name"], value="rainfall").orderBy("hour").collect()
    assert [(r.station_name, r.hourly_rain_sum) for r in hr] == [("Hefez Hayim", 2.0), ("Hefez Hayim", 0.0),
                                                                  ("Hefez Hayim", 2.0)]
    write(str(tmp_path / "sorek_2010_2019.csv"),
          "1,17,x,Sorek,2020,01/02/2020 10:00:00,0.1,3.5,a,b,c\n1,17,x,Sorek,2020,01/02/2020 12:30:00,0.1,n/a,a,b,c\n")
    fl = grid.hourly_flow(files.read_flow_csv(spark, str(tmp_path / "sorek_2010_2019.csv")),
                          keys=["station_code"]).orderBy("hour").collect()
    assert [r.flow for r in fl] == [3.5, 3.5, 3.5]
