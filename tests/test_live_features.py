"""Features and scores from kept state equal those of the whole history."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from floodlake.operators import boost, features
from floodlake.sinks.versions import VersionedTable
from floodlake.streaming import live_features, streams
from test_longseries import merged

KEYS = ["basin_id", "hour"]


def test_hours_that_arrive_in_batches_score_as_the_whole_history(spark, tmp_path):
    hours = merged(spark, 700).cache()
    whole = features.clean_features(hours)
    train = whole.withColumn("label", (F.col("flow") > 2).cast("int"))
    fitted = boost.fit_boosted(train, features.FEATURE_NAMES, "label", settings=boost.Settings(
        rounds=2, depth=2, row_share=1.0, feature_share=1.0, bins=8))
    boost.save(spark, fitted, str(tmp_path / "model"))
    model, _ = boost.load(spark, str(tmp_path / "model"))
    want = boost.predict(whole, fitted, "p").orderBy(*KEYS).toPandas()
    state, out = str(tmp_path / "state"), str(tmp_path / "out")
    body = live_features.feature_batches(state, out, lambda f: boost.predict(f, model, "p"))
    t0, cuts = dt.datetime(2023, 11, 1), [0, 260, 261, 700]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        at = F.col("hour").between(t0 + dt.timedelta(hours=a), t0 + dt.timedelta(hours=b - 1))
        part = hours.where(at)
        if k == 1:      # an hour that is late, one that comes twice, one without a basin
            part = part.unionByName(hours.where(F.col("hour") == t0 + dt.timedelta(hours=9)).withColumn("flow", F.lit(99.0)))
            part = part.unionByName(part).unionByName(part.limit(1).withColumn("basin_id", F.lit(None).cast("int")))
        body(part, k)
        if k == 1:
            body(part, k)       # run again: the same rows, no other state
    got = spark.read.parquet(out).drop("batch_id").orderBy(*KEYS).select(*want.columns).toPandas()
    assert len(want) > 500 and (got[KEYS] == want[KEYS]).all().all()
    assert np.allclose(got.drop(columns="hour").to_numpy(dtype=float), want.drop(columns="hour").to_numpy(dtype=float), atol=1e-9)
    kept = VersionedTable(spark, state).read()
    assert {r["count"] for r in kept.groupBy("basin_id").count().collect()} == {192}


def test_no_hours(spark, tmp_path):
    hours = merged(spark, 10)
    built, state = live_features.advance(None, hours.limit(0))
    assert built.count() == 0 and state.count() == 0
    built, state = live_features.advance(state, hours)
    assert built.count() == 0 and state.count() == hours.count()
    assert streams.batch_folder(str(tmp_path)) is not None
