"""Predicates, defaults and station-registry joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default alert threshold (mm in one 10-minute reading) and
# the status code of a valid reading.
HIGH_RAIN_MM = 5.0
VALID_STATUS = 1


def quality_filter(df: DataFrame, value: str = "rain_amount_mm", status: str = "status") -> DataFrame:
    """Drop hardware sentinels (negative values) and readings with a bad status."""
    return df.filter((F.col(value) >= 0) & (F.col(status) == VALID_STATUS))


def high_rainfall(df: DataFrame, threshold: float = HIGH_RAIN_MM,
                  value: str = "rain_amount_mm") -> DataFrame:
    """Readings at or above ``threshold`` (inclusive), heaviest first."""
    return (df.filter(F.col(value) >= threshold)
            .select("station_name", "measurement_time", value)
            .orderBy(F.col(value).desc(), "station_name", "measurement_time"))


def fill_defaults(df: DataFrame) -> DataFrame:
    """Region unknown -> NULL; status absent -> 1."""
    cols = df.columns
    region = F.col("region_id") if "region_id" in cols else F.lit(None).cast("int")
    status = F.coalesce(F.col("status"), F.lit(VALID_STATUS)) if "status" in cols else F.lit(VALID_STATUS)
    return df.withColumn("region_id", region).withColumn("status", status.cast("int"))


def registered(df: DataFrame, stations: DataFrame, key: str = "station_id") -> DataFrame:
    """Readings whose station exists in the registry (EXISTS -> semi join)."""
    return df.join(stations.select(key), key, "left_semi")


def unregistered(df: DataFrame, stations: DataFrame, key: str = "station_id",
                 name: str = "station_name") -> DataFrame:
    """One ``id (name)`` entry per reading of an unknown station (not distinct)."""
    return (df.join(stations.select(key), key, "left_anti")
            .select(key, name, F.format_string("%d (%s)", F.col(key), F.col(name)).alias("entry")))


def union_files(dfs: Sequence[DataFrame]) -> DataFrame:
    """Union-all of several inputs by column name, duplicates kept."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out
