"""Streaming operators on landed files and the model layer."""

import datetime as dt

from pyspark.sql import functions as F

from floodlake.operators import ml
from floodlake.operators.features import FEATURE_NAMES
from floodlake.streaming import streams

T = dt.datetime(2024, 1, 1)


def test_session_stream_emits_closed_sessions(spark, tmp_path):
    times = [T, T + dt.timedelta(days=7), T + dt.timedelta(days=20)]
    df = spark.createDataFrame([(0, t, 30.0) for t in times] + [(0, T + dt.timedelta(days=3), 1.0)],
                               "basin_id int, measurement_time timestamp_ntz, flow double")
    land = str(tmp_path / "land")
    df.write.parquet(land)
    s = streams.event_time(streams.ingest_stream(spark, land, df.schema), "measurement_time")
    out = str(tmp_path / "out")
    streams.run_available(streams.session_stream(s, 10.0, "7 days", delay="0 seconds").select(
        "basin_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n_readings"), out)
    # the first session (exact 7-day gap joins it) has closed under the
    # watermark; the one still open at the end of the input is not emitted
    final = spark.read.parquet(out).collect()
    assert [(r.n_readings, r.end) for r in final] == [(2, T + dt.timedelta(days=14))]


def test_sessions_over_several_polls_with_a_late_reading(spark, tmp_path):
    """Three polls: a session continues over two of them, a reading behind the
    watermark is dropped, the session still open at the end is in the state."""
    hours = lambda *h: [(0, T + dt.timedelta(hours=x), 20.0 + x) for x in h]
    land, out = str(tmp_path / "land"), str(tmp_path / "out")
    schema = "basin_id int, measurement_time timestamp_ntz, flow double"
    for rows in (hours(0, 1, 10), hours(11, 12, 30), hours(31, 5)):
        df = spark.createDataFrame(rows, schema)
        df.write.mode("append").parquet(land)
        s = streams.event_time(streams.ingest_stream(spark, land, df.schema), "measurement_time")
        streams.run_available(streams.session_stream(s, 10.0, "2 hours", delay="1 hour"), out)
    closed = spark.read.parquet(out)
    assert len([p for p in (tmp_path / "out_checkpoint" / "commits").iterdir() if p.name.isdigit()]) >= 3
    assert sorted((r.n_readings, r.peak_flow) for r in closed.collect()) == [(2, 21.0), (3, 32.0)]
    still = streams.open_sessions(spark, out + "_checkpoint").collect()
    assert [(r.basin_id, r.n_readings, r.peak_flow, r.s.end) for r in still] == [(0, 2, 51.0, T + dt.timedelta(hours=33))]


def test_dedup_within_watermark(spark, tmp_path):
    rows = [(1, T, 1.0), (1, T, 1.0), (2, T, 3.0)]
    df = spark.createDataFrame(rows, "station_id int, measurement_time timestamp_ntz, rain_amount_mm double")
    land = str(tmp_path / "land")
    df.write.parquet(land)
    s = streams.event_time(streams.ingest_stream(spark, land, df.schema), "measurement_time")
    out = str(tmp_path / "out")
    streams.run_available(streams.dedup_stream(s, ["station_id", "measurement_time"]), out)
    assert spark.read.parquet(out).count() == 2


def frame(spark, n=240):
    rows = []
    for i in range(n):
        vals = [float((i * (k + 3)) % 17) for k in range(len(FEATURE_NAMES))]
        rows.append((0, T + dt.timedelta(hours=i), float(i % 40), int(i % 40 > 25), *vals))
    schema = "basin_id int, hour timestamp_ntz, flow double, label int, " + ", ".join(f"{c} double" for c in FEATURE_NAMES)
    return spark.createDataFrame(rows, schema)


def test_missing_feature_scores_as_zero(spark):
    df = frame(spark).drop("Soil_Moisture_EWM")
    aligned = ml.align_features(df, FEATURE_NAMES, keep=["basin_id"])
    assert aligned.columns == ["basin_id"] + FEATURE_NAMES
    assert aligned.agg(F.max("Soil_Moisture_EWM")).first()[0] == 0.0


def test_models_fit_score_and_bundle(spark, tmp_path):
    df = frame(spark)
    rf = ml.train_rf(df, numTrees=10, maxDepth=4)
    bundle = ml.Bundle(basin="0", model_type="random_forest", flood_stage=25.0, decision_threshold=0.5)
    scored = ml.score(df, rf, bundle).collect()
    assert len(scored) == 240 and all(0.0 <= r.flood_probability <= 1.0 for r in scored)
    gbc = ml.train_gbt_classifier(df, maxIter=5)
    assert ml.score(df, gbc, ml.Bundle("0", "gbt", 25.0, decision_threshold=0.3)).count() == 240
    gbr = ml.train_gbt_regressor(df.filter(F.col("hour") < T + dt.timedelta(hours=200)),
                                 df.filter(F.col("hour") >= T + dt.timedelta(hours=200)), maxIter=5)
    assert gbr.transform(df).count() == 240
    path = str(tmp_path / "bundle")
    ml.save_bundle(spark, rf, bundle, path)
    model, meta = ml.load_bundle(spark, path)
    assert meta.decision() == 0.5 and meta.horizon() == 3 and meta.feature_names == FEATURE_NAMES
    imp = ml.importances(spark, model, FEATURE_NAMES).collect()
    assert len(imp) == len(FEATURE_NAMES) and abs(sum(r.importance for r in imp) - 1.0) < 1e-9


def test_score_stream_batches(spark, tmp_path):
    df = frame(spark, 120)
    model = ml.train_rf(df, numTrees=5, maxDepth=3)
    land = str(tmp_path / "features")
    df.drop("label").repartition(3).write.parquet(land)
    s = streams.ingest_stream(spark, land, spark.read.parquet(land).schema, files_per_trigger=1)
    out = str(tmp_path / "scores")
    bundle = ml.Bundle("0", "random_forest", 25.0, decision_threshold=0.03)
    score = streams.score_batches(model, bundle, out)
    streams.run_available(s, out, batch_fn=score)
    scored = spark.read.parquet(out)
    assert scored.count() == 120 and scored.select("batch_id").distinct().count() == 3
    assert scored.filter((F.col("flood_probability") >= 0.03) != (F.col("alert") == 1)).count() == 0
    # a replayed batch replaces itself, and a batch without one of the features is scored with zeros there
    again = spark.read.parquet(land).limit(40).drop("Soil_Moisture_EWM")
    score(again, 2)
    score(again, 2)
    assert spark.read.parquet(out).where("batch_id = 2").count() == 40


def test_replayed_stream_batch_adds_no_row(spark, tmp_path):
    df = spark.createDataFrame([(1, 6.0), (2, 7.0)], "station_id int, rain_amount_mm double")
    out = str(tmp_path / "alerts")
    write = streams.batch_folder(out)
    for batch in (0, 0, 1):
        write(df, batch)
    assert spark.read.parquet(out).groupBy("batch_id").count().orderBy("batch_id").collect() == [(0, 2), (1, 2)]


def test_bundle_without_threshold_is_refused():
    import pytest
    with pytest.raises(ValueError):
        ml.Bundle("0", "gbt", 25.0).decision()


def test_early_warning_takes_each_basins_own_level(spark):
    from floodlake.plans import models
    one = frame(spark)
    both = one.unionByName(one.withColumn("basin_id", F.lit(1))).drop("label")
    out = models.early_warning(both, [0, 1], {0: 20.0, 1: 30.0}, "2024-01-08 00:00:00", maxIter=3)
    assert [out[b]["bundle"].flood_stage for b in (0, 1)] == [20.0, 30.0]
    positives = [out[b]["scored"].agg(F.sum("label")).first()[0] for b in (0, 1)]
    assert positives[0] > positives[1] > 0


def test_time_slice_inclusive(spark):
    from floodlake.operators.events import time_slice
    df = spark.createDataFrame([(0, T + dt.timedelta(hours=i)) for i in range(10)], "basin_id int, hour timestamp_ntz")
    out = time_slice(df, "2024-01-01 02:00:00", "2024-01-01 05:00:00")
    assert out.count() == 4


def test_feature_columns_and_union(spark):
    from floodlake.operators.quality import union_files
    df = frame(spark, 4)
    cols = ml.feature_columns(df, target=("flow", "label"))
    assert cols == FEATURE_NAMES
    both = union_files([df.select("basin_id", "flow"), df.select("flow", "basin_id")])
    assert both.count() == 8 and both.columns == ["basin_id", "flow"]
