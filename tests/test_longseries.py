"""Series spread over tasks give the rows of the one-task operators."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from floodlake.operators import features, longseries


def test_scan_over_several_levels_equals_the_sequential_mean(spark):
    """A series of 10^6 rows, three levels of blocks, no task with more than a block."""
    n = 1_000_000
    df = spark.range(0, n, 1, 16).select(F.lit(1).alias("basin_id"), F.col("id").alias("_r"),
                                         (F.pmod(F.xxhash64("id"), F.lit(1000)) / 100.0).alias("x"))
    x = np.array([r.x for r in df.orderBy("_r").select("x").toLocalIterator()])
    want = pd.Series(x).ewm(alpha=0.02, adjust=False).mean().shift(1).to_numpy()
    out = longseries.ewm_scan(df, "x", "y", block=64, fan=16).orderBy("_r").select("y").toPandas()["y"].to_numpy()
    assert np.isnan(out[0]) and np.allclose(out[1:], want[1:], rtol=1e-11, atol=1e-12)


@pytest.mark.parametrize("alpha,shift", [(0.02, 0), (0.5, 1), (1.0, 0)])
def test_scan_of_short_series_and_gaps(spark, alpha, shift):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for basin, n in ((0, 300), (1, 1), (2, 17)):
        t = sorted(rng.choice(9000, n, replace=False).tolist())
        x = rng.gamma(1, 2, n)
        rows += [(basin, dt.datetime(2020, 1, 1) + dt.timedelta(hours=int(h)), float(v)) for h, v in zip(t, x)]
        want[basin] = pd.Series(x).ewm(alpha=alpha, adjust=False).mean().shift(shift).to_numpy()
    df = longseries.with_row_index(spark.createDataFrame(rows, "basin_id int, hour timestamp_ntz, x double").repartition(5), days=7)
    assert [r._r for r in df.where("basin_id = 0").orderBy("hour").collect()] == list(range(300))
    out = longseries.ewm_scan(df, "x", "y", alpha, shift, block=5, fan=3).orderBy("basin_id", "_r").toPandas()
    for basin, exp in want.items():
        assert np.allclose(out[out.basin_id == basin].y.to_numpy(dtype=float), exp, rtol=1e-9, equal_nan=True)


def merged(spark, n=900):
    rng = np.random.default_rng(7)
    rows = []
    for basin in (0, 1):
        rain = rng.gamma(0.3, 2.0, n) * (rng.random(n) > 0.7)
        flow = np.where(rng.random(n) > 0.9, rng.gamma(2, 4, n), rng.random(n))
        for k in range(n):
            if k % 97 != 5:     # gaps: windows count rows, not hours
                rows.append((basin, dt.datetime(2023, 11, 1) + dt.timedelta(hours=k), float(rain[k]), float(rain[k] * 2), 0.1,
                             int(rain[k] > 0), float(rain[k] / 2), float(rain[k] / 3), float(flow[k])))
    return spark.createDataFrame(rows, "basin_id int, hour timestamp_ntz, Basin_Rain_Mean double, Basin_Rain_Max double, Basin_Rain_Std double, "
                                 "Basin_Rain_Count long, Basin_Intensity_Max double, Basin_Intensity_Mean double, flow double")


def test_chunked_features_equal_the_one_task_features(spark):
    df = merged(spark)
    want = features.clean_features(df).orderBy("basin_id", "hour").toPandas()
    got = longseries.clean_features(df, rows=200, block=50, fan=4).orderBy("basin_id", "hour").toPandas()
    assert len(want) > 500 and list(got.columns) == list(want.columns)
    assert (got[["basin_id", "hour"]] == want[["basin_id", "hour"]]).all().all()
    assert np.allclose(got.drop(columns="hour").to_numpy(dtype=float), want.drop(columns="hour").to_numpy(dtype=float), atol=1e-9)


def test_one_basin_is_in_many_tasks(spark):
    numbered = longseries.with_row_index(merged(spark).where("basin_id = 0"), days=10)
    plan = longseries.with_halo(numbered, rows=200)
    sizes = {r._chunk: r.n for r in plan.groupBy("_chunk").agg(F.count("*").alias("n")).collect()}
    assert len(sizes) >= 5 and max(sizes.values()) <= 200 + longseries.HALO_ROWS
    out = longseries.clean_features(merged(spark), rows=200)
    text = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in text.splitlines() if "Window [" in line]
    assert windows and all("_chunk" in line or "_blk" in line for line in windows)     # no window over a whole basin
