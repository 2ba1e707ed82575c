"""Settlement matching (E3): forecast locations from the feed file, matched
to settlements by radius and name, written as the review listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..operators.match import MATCH_RADIUS_KM, geo_match
from ..sources import feeds


def match_locations(spark: SparkSession, forecast_path: str, settlements: DataFrame,
                    review_path: str | None = None, radius_km: float = MATCH_RADIUS_KM) -> DataFrame:
    raw = spark.read.format("xml").option("rowTag", "Location").schema(feeds.FORECAST_LOCATION).load(forecast_path)
    locs = feeds.location_coords(raw.select(F.struct(*raw.columns).alias("loc")))
    matches = geo_match(locs.withColumn("ims_id", F.col("ims_id").cast("long")), settlements, radius_km)
    if review_path:
        sinks.write_review(matches, review_path)
    return matches
