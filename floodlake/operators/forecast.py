"""Forecast windows, picking, matching and the settlement update."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timecols import forecast_windows


def forecast_pick(forecast: DataFrame, as_of: Column | str, location: str = "location_id") -> DataFrame:
    """Per location: rain of the current and the next 6-hour window at
    ``as_of`` (a literal or a per-location column). Missing window or
    missing rain -> 0.0; duplicates of a (location, time): the last in
    feed order (``pos``) wins."""
    at = F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of
    cur, nxt = forecast_windows(at)
    x = forecast.withColumn("_cur", cur).withColumn("_nxt", nxt)
    is_cur = F.col("forecast_time") == F.col("_cur")
    is_nxt = F.col("forecast_time") == F.col("_nxt")
    rain = F.coalesce(F.col("rain"), F.lit(0.0))
    # feed order: element (if several Location elements) then position
    order = F.struct("element", "pos") if "element" in forecast.columns else F.col("pos")
    g = x.groupBy(location).agg(
        F.max_by(F.when(is_cur, rain), F.when(is_cur, order)).alias("current_rain"),
        F.max_by(F.when(is_nxt, rain), F.when(is_nxt, order)).alias("next_rain"))
    return g.select(location, F.coalesce("current_rain", F.lit(0.0)).alias("current_rain"),
                    F.coalesce("next_rain", F.lit(0.0)).alias("next_rain"))


def mapping_clean(mapping: DataFrame) -> DataFrame:
    """Mapping rows with a matched settlement; id as int, location id as text key."""
    return (mapping.filter(F.col("matched_id").isNotNull())
            .select(F.col("ims_id").cast("string").alias("ims_key"),
                    F.col("matched_id").cast("double").cast("int").alias("settlement_id"),
                    "score", "distance_km", F.col("ims_id")))


def forecast_match(mapping: DataFrame, picked: DataFrame, location: str = "location_id") -> DataFrame:
    """Mapping x picked forecast on the location id compared as text."""
    p = picked.select(F.col(location).cast("string").alias("ims_key"), "current_rain", "next_rain")
    return mapping_clean(mapping).join(p, "ims_key").drop("ims_key")


def update_forecasts(settlements: DataFrame, matched: DataFrame) -> DataFrame:
    """New forecast columns for matched settlements, old values elsewhere.
    A settlement mapped twice takes the best score, then the nearest, then
    the smallest location id."""
    rank = F.struct(F.col("score"), (-F.col("distance_km")).alias("d"), (-F.col("ims_id")).alias("i"))
    best = (matched.groupBy("settlement_id")
            .agg(F.max_by(F.struct("current_rain", "next_rain"), rank).alias("_b"))
            .select("settlement_id", F.col("_b.current_rain").alias("_cur"), F.col("_b.next_rain").alias("_nxt")))
    s = settlements
    for c in ("current_6h_forecast", "next_6h_forecast"):
        if c not in s.columns:
            s = s.withColumn(c, F.lit(None).cast("double"))
    return (s.join(best, "settlement_id", "left")
            .withColumn("current_6h_forecast", F.coalesce("_cur", "current_6h_forecast"))
            .withColumn("next_6h_forecast", F.coalesce("_nxt", "next_6h_forecast"))
            .drop("_cur", "_nxt"))
