"""Window maxima from blocks of hours equal a scan of the raw readings."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from floodlake.operators.rangemax import blocks, window_maxima

T = dt.datetime(2023, 12, 25, 7)


def test_blocks_cover_every_hour_once(spark):
    spans = [(a, b) for a in (-5, 0, 1, 6, 7, 473_000) for b in (a + 1, a + 2, a + 3, a + 8, a + 37, a + 1000)]
    df = spark.createDataFrame(spans, "a long, b long").select("a", "b", blocks(F.col("a"), F.col("b")).alias("p"))
    for r in df.collect():
        hours = [h for p in r.p for h in range(p.block << p.size, (p.block + 1) << p.size)]
        assert sorted(hours) == list(range(r.a, r.b))
        assert len(r.p) <= 2 * (r.b - r.a).bit_length()


@pytest.mark.parametrize("time_type", ["timestamp_ntz", "timestamp"])
def test_window_maxima_equal_brute_force(spark, time_type):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 1), T + dt.timedelta(seconds=rnd.choice([rnd.randint(0, 3_000_000), 3600 * rnd.randint(0, 800)])),
             rnd.random(), None if rnd.random() < 0.1 else rnd.random()) for _ in range(3000)] + [(0, None, 9.0, 9.0)]
    windows = []
    for e in range(120):
        lo = T + dt.timedelta(seconds=rnd.choice([rnd.randint(-9000, 3_000_000), 3600 * rnd.randint(0, 800)]))
        length = rnd.choice([0, 59, 3600, 7200, rnd.randint(0, 20_000), rnd.randint(0, 2_000_000), -60])
        windows.append((rnd.randint(0, 1), e, lo, lo + dt.timedelta(seconds=length)))
    windows.append((0, 500, None, T))
    s = spark.createDataFrame(rows, "basin_id int, t timestamp_ntz, x double, y double").withColumn("t", F.col("t").cast(time_type))
    w = spark.createDataFrame(windows, "basin_id int, event_id int, lo timestamp_ntz, hi timestamp_ntz")
    w = w.withColumn("lo", F.col("lo").cast(time_type)).withColumn("hi", F.col("hi").cast(time_type))
    got = {(r.basin_id, r.event_id): (r.x, r.y, r.n) for r in window_maxima(s, w, ["x", "y"], "t", "lo", "hi").collect()}
    want = {}
    for b, e, lo, hi in windows:
        hit = [r for r in rows if r[0] == b and r[1] is not None and lo is not None and lo <= r[1] <= hi]
        if hit:
            ys = [r[3] for r in hit if r[3] is not None]
            want[b, e] = (max(r[2] for r in hit), max(ys) if ys else None, len(hit))
    assert got == want and len(want) > 60
    assert window_maxima(s.limit(0), w, ["x", "y"], "t", "lo", "hi").count() == 0
    assert window_maxima(s, w.limit(0), ["x", "y"], "t", "lo", "hi").count() == 0
