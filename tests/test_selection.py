"""Selection of order statistics against numpy."""

import random

import numpy as np
import pytest

from floodlake.operators import selection, stats


def series():
    rnd = random.Random(4)
    out = {0: [rnd.gauss(0, 1) for _ in range(900)], 1: [1.0] * 300 + [2.0] * 10, 2: [5.0], 3: [rnd.choice([0.0, 1e-300, 1e300, -1e300, 7.0]) for _ in range(200)],
           4: [10.0 ** rnd.uniform(-12, 12) for _ in range(400)], 5: [float(k) for k in range(101)]}
    rows = [(k, v) for k, vs in out.items() for v in vs] + [(5, None), (6, None), (2, float("nan"))]
    rnd.shuffle(rows)
    return out, rows


@pytest.mark.parametrize("buckets,few", [(4, 3), (16, 0), (256, 4096)])
def test_quantiles_equal_numpy(spark, buckets, few):
    out, rows = series()
    df = spark.createDataFrame(rows, "basin_id int, x double").repartition(5)
    probs = [0.0, 0.1, 0.5, 0.95, 0.999, 1.0]
    got = {r.basin_id: r for r in selection.quantiles(df, "x", probs, buckets=buckets, few=few).collect()}
    assert set(got) == set(out)
    for k, vs in out.items():
        assert got[k].n == len(vs)
        assert np.allclose(got[k].q, np.quantile(vs, probs), rtol=1e-12, atol=0), k


def test_flow_distribution_holds_no_values_of_a_basin(spark):
    _, rows = series()
    df = spark.createDataFrame(rows, "basin_id int, flow double")
    out = stats.flow_distribution(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan
    got = {r.basin_id: r for r in out.collect()}
    assert got[5].median_flow == 50.0 and got[5].p99_flow == 99.0 and got[6].median_flow is None


def test_no_rows(spark):
    df = spark.createDataFrame([], "basin_id int, x double")
    assert selection.quantiles(df, "x", [0.5]).count() == 0
