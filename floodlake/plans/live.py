"""The hourly live cycle (E1) over landed files.

An outside collector lands, every hour: the station catalog (JSON array),
the latest measurement envelope of each station (JSON lines,
``{"stationId": ..., "data": [...]}``), the forecast XML and the warnings
RSS. Each step below is one Spark job chain; the stored measurements are a
day-partitioned parquet table (see ``sinks.insert_new``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..operators import alerts, forecast, quality
from ..sources import feeds, files


def latest_records(spark: SparkSession, catalog_path: str, latest_path: str) -> DataFrame:
    """One record per station with a rain channel and a non-empty envelope:
    id, name, region, time, value, status (no quality filter here)."""
    stations = feeds.read_stations(spark, catalog_path)
    rec = feeds.read_envelopes(spark, latest_path).select("station_id", feeds.latest_reading(F.col("env")).alias("r"))
    rec = rec.filter(F.col("r").isNotNull()).select("station_id", "r.*")
    return rec.join(stations.select("station_id", "station_name", "region_id"), "station_id")


def sync_rain(spark: SparkSession, catalog_path: str, latest_path: str, registry: DataFrame,
              store_path: str) -> int:
    """Fetch-and-store step: insert the new latest readings of registered
    stations; returns the number of rows inserted (0 on a rerun)."""
    rec = latest_records(spark, catalog_path, latest_path).withColumn("event_id", F.col("station_id").cast("long"))
    return sinks.insert_new(rec, store_path, registry)


def rain_alerts(spark: SparkSession, store_path: str, threshold: float = quality.HIGH_RAIN_MM) -> DataFrame:
    """Analyze step: readings at or above the threshold as digest lines."""
    stored = spark.read.parquet(store_path)
    return alerts.alert_digest(stored.filter(F.col("rain_amount_mm") >= threshold), threshold)


def update_settlement_forecasts(spark: SparkSession, forecast_path: str, mapping_path: str,
                                settlements: DataFrame, as_of: str) -> DataFrame:
    """Forecast step: current and next 6-hour rain per mapped settlement."""
    picked = forecast.forecast_pick(feeds.read_forecast(spark, forecast_path), as_of)
    mapping = files.read_mapping(spark, mapping_path)
    return forecast.update_forecasts(settlements, forecast.forecast_match(mapping, picked))


def warnings_digest(spark: SparkSession, rss_path: str, as_of_date: str) -> DataFrame:
    items = feeds.read_warnings(spark, rss_path).withColumn("item_id", F.monotonically_increasing_id())
    return alerts.warnings_digest(items, as_of_date)
