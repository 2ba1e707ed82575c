import json
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from floodlake.functions import text, timecols
from floodlake.operators import events, features, grid, live
from floodlake.session import read_if_there
from floodlake.sources import dims, feeds


@pytest.mark.parametrize("alpha", [0.02, 0.5, 0.9, 0.999, 1.0])
def test_ewm_stays_exact_for_any_alpha(spark, alpha):
    x = [float((i * 37) % 101) for i in range(700)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "basin_id int, hour int, x double")
    got = [r.y for r in features.ewm(df, "x", "y", alpha=alpha, shift=0).orderBy("hour").collect()]
    assert got == pytest.approx(pd.Series(x).ewm(alpha=alpha, adjust=False).mean().tolist())


def test_forecast_windows_and_hours_on_the_day_the_clock_changes(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Jerusalem")
    try:
        df = spark.createDataFrame([(datetime(2024, 3, 29, h, 10),) for h in (2, 4, 10, 16, 22)], "t timestamp_ntz")
        got = [tuple(r) for r in df.select(timecols.window_start(F.col("t")), grid.truncate(df, "t"), grid.truncate(df, "t", "day")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    day = lambda h, d=29: datetime(2024, 3, d, h)
    assert got == [(day(21, 28), day(2), day(0)), (day(3), day(4), day(0)), (day(9), day(10), day(0)),
                   (day(15), day(16), day(0)), (day(21), day(22), day(0))]


def test_a_missing_flow_is_never_the_peak(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1), None), (1, datetime(2024, 1, 20), 3.0)], "basin_id int, hour timestamp_ntz, flow double")
    assert {r.peak_time for r in events.peak_hydrograph(df).collect()} == {datetime(2024, 1, 20)}


def test_the_flow_file_chain(spark, tmp_path):
    index = [(r.raw_name, r.sub_basin) for r in dims.feed_names(spark).collect()]
    sub = index[0][1]
    names = [n for n, s in index if s == sub][:1] * 2
    feed = [{"name": n, "obs": [{"flow": f, "date": "01/01/2024", "time": "10:00"}]} for n, f in zip(names, ["n/a", "9.5"])]
    (tmp_path / "flow.json").write_text(json.dumps(feed))
    got = live.basin_peak_flow(live.first_valid_obs(feeds.read_flow_feed(spark, str(tmp_path / "flow.json"))), dims.feed_names(spark)).collect()
    assert [(r.sub_basin, r.flow_m3s) for r in got] == [(sub, 9.5)]


def test_names_from_files_are_title_case_behind_hyphens(spark):
    df = spark.createDataFrame([("/x/tel-aviv_coast_2010_2018.csv",), ("jerusalem_center_2010_2018.csv",)], "p string")
    assert [r[0] for r in df.select(text.station_from_file(F.col("p"))).collect()] == ["Tel-Aviv Coast", "Jerusalem Center"]


def test_only_a_missing_table_counts_as_none(spark, tmp_path):
    assert read_if_there(spark, str(tmp_path / "none")) is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        read_if_there(spark, str(tmp_path / "bad"))
