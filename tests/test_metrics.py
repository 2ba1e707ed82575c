"""Metric operators against direct formulas on random inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodlake.operators import metrics


def auc_brute(labels, scores):
    pos = [s for l, s in zip(labels, scores) if l == 1]
    neg = [s for l, s in zip(labels, scores) if l == 0]
    tot = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


@pytest.mark.parametrize("ranges", [1, 3, 256, 10000])
def test_roc_auc_with_ties(spark, ranges):
    rnd = random.Random(11)
    rows = [(b, int(rnd.random() < 0.3), round(rnd.random(), 2)) for b in (0, 1) for _ in range(400)]
    df = spark.createDataFrame(rows, "basin_id int, label int, proba double")
    got = {r.basin_id: r.roc_auc for r in metrics.roc_auc(df, ranges=ranges).collect()}
    for b in (0, 1):
        lab = [r[1] for r in rows if r[0] == b]
        sc = [r[2] for r in rows if r[0] == b]
        assert got[b] == pytest.approx(auc_brute(lab, sc), rel=1e-12)


def test_roc_auc_of_scores_that_crowd(spark):
    """Nearly all scores lie below 1e-6: their ranges still hold about as many as any other."""
    rnd = random.Random(5)
    rows = [(0, int(rnd.random() < 0.2), rnd.random() * (1e-6 if i % 50 else 1.0)) for i in range(4000)]
    df = spark.createDataFrame(rows, "basin_id int, label int, proba double")
    got = metrics.roc_auc(df, ranges=16).first()
    assert got.roc_auc == pytest.approx(auc_brute([r[1] for r in rows], [r[2] for r in rows]), rel=1e-12)
    assert (got.positives, got.positives + got.negatives) == (sum(r[1] for r in rows), 4000)
    bounds = df.agg(F.percentile_approx("proba", [k / 16 for k in range(1, 16)], 160).alias("b"))
    sizes = (df.join(bounds).groupBy(metrics._range_of(F.col("b"), F.col("proba"), 16).alias("r")).count().collect())
    assert len(sizes) == 16 and max(r["count"] for r in sizes) <= 2 * 4000 / 16


def test_roc_auc_without_rows_or_with_one_class(spark):
    df = spark.createDataFrame([(0, 1, 0.5), (None, 0, 0.1), (None, 1, 0.3)], "basin_id int, label int, proba double")
    got = {r.basin_id: (r.roc_auc, r.positives, r.negatives) for r in metrics.roc_auc(df).collect()}
    assert got == {0: (None, 1, 0), None: (1.0, 1, 1)}
    assert metrics.roc_auc(df.limit(0)).count() == 0


def test_class_report_zero_division(spark):
    df = spark.createDataFrame([(0, 0, 0), (0, 0, 0), (0, 1, 0)], "basin_id int, label int, pred int")
    rep = {r["class"]: r for r in metrics.class_report(df).collect()}
    assert rep["1"].precision == 0.0 and rep["1"].recall == 0.0 and rep["1"].f1 == 0.0
    assert rep["accuracy"].f1 == pytest.approx(2 / 3)
    assert rep["0"].support == 2 and rep["weighted avg"].support == 3


def test_regression_and_flood_metrics(spark):
    rnd = np.random.default_rng(5)
    y = rnd.gamma(1.0, 10.0, 200)
    p = y + rnd.normal(0, 3, 200)
    df = spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(y, p)],
                               "basin_id int, actual double, predicted double")
    r = metrics.regression_metrics(df).collect()[0]
    pc = np.clip(p, 0, None)
    assert r.mae == pytest.approx(np.mean(np.abs(y - pc)))
    assert r.rmse == pytest.approx(np.sqrt(np.mean((y - pc) ** 2)))
    assert r.r2 == pytest.approx(1 - np.sum((y - pc) ** 2) / np.sum((y - y.mean()) ** 2))
    f = metrics.flood_metrics(df, 25.0).collect()[0]
    real = y > 25
    assert f.flood_hours == real.sum() and f.true_pos == ((pc > 25) & real).sum()
    none = metrics.flood_metrics(df, 1e9).collect()[0]
    assert (none.flood_hours, none.recall_pct, none.flood_mae) == (0, 0.0, 0.0)
