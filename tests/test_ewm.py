"""Blocked EWM scan against pandas' sequential ewm(adjust=False)."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from floodlake.operators.features import ewm


@pytest.mark.parametrize("block", [1, 7, 512])
def test_ewm_matches_sequential(spark, block):
    rng = np.random.default_rng(1)
    rows = []
    expected = {}
    for basin, n in ((0, 300), (1, 45), (2, 1)):
        x = rng.gamma(0.5, 2.0, n) * (rng.random(n) > 0.6)
        t = [dt.datetime(2020, 1, 1) + dt.timedelta(hours=i) for i in range(n)]
        rows += [(basin, a, float(b)) for a, b in zip(t, x)]
        expected[basin] = pd.Series(x).ewm(alpha=0.02, adjust=False).mean().shift(1).tolist()
    df = spark.createDataFrame(rows, "basin_id int, hour timestamp_ntz, x double")
    out = ewm(df, "x", "y", block=block).orderBy("basin_id", "hour").collect()
    for basin, exp in expected.items():
        got = [r.y for r in out if r.basin_id == basin]
        assert got[0] is None
        assert np.allclose(got[1:], exp[1:], rtol=1e-12, atol=1e-12)
