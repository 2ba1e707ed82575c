"""Landed JSON / XML feeds as DataFrames.

Each source has two entry points: ``read_*(spark, path)`` for files, and
``parse_*(col)`` for a column of raw text (the same parsing, used when
the text already sits in a table). Schemas are explicit; malformed
records become NULL (PERMISSIVE), never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, StringType, StructField,
                               StructType)

from ..functions.timecols import parse_time
from ..operators.quality import quality_filter

# The monitor that carries rain, the measurement time
# layouts of the station API, and the markup wrapped around warning text.
RAIN_MONITOR = "Rain"
API_TIME_PATTERNS = ["yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss"]
WARNING_OPEN_TAG = "<p style='padding-bottom:30px;'>"
WARNING_CLOSE_TAG = "</p>"

MONITOR = StructType([StructField("channelId", IntegerType()), StructField("name", StringType())])
STATION = StructType([
    StructField("stationId", IntegerType()), StructField("name", StringType()),
    StructField("regionId", IntegerType()), StructField("monitors", ArrayType(MONITOR)),
])
CHANNEL = StructType([StructField("value", DoubleType()), StructField("status", IntegerType())])
MEASURE = StructType([StructField("datetime", StringType()), StructField("channels", ArrayType(CHANNEL))])
ENVELOPE = StructType([StructField("data", ArrayType(MEASURE))])
LANDED_ENVELOPE = StructType([StructField("stationId", IntegerType())] + list(ENVELOPE.fields))
OBS = StructType([StructField("flow", StringType()), StructField("date", StringType()),
                  StructField("time", StringType())])
FLOW_STATION = StructType([StructField("name", StringType()), StructField("obs", ArrayType(OBS))])
FORECAST_LOCATION = StructType([
    StructField("LocationMetaData", StructType([
        StructField("LocationId", StringType()), StructField("LocationNameEng", StringType()),
        StructField("DisplayLat", StringType()), StructField("DisplayLon", StringType())])),
    StructField("LocationData", StructType([
        StructField("Forecast", ArrayType(StructType([
            StructField("ForecastTime", StringType()), StructField("Rain", StringType())])))])),
])
WARNING_ITEM = StructType([StructField("title", StringType()), StructField("description", StringType())])


# ------------------------------------------------------------ stations

def rain_channel(stations: DataFrame) -> DataFrame:
    """Keep id, name, region and the channel of the first monitor named
    Rain; stations without one (absent, NULL or 0) are dropped."""
    first = F.get(F.filter(F.coalesce("monitors", F.array().cast(ArrayType(MONITOR))),
                           lambda m: m["name"] == RAIN_MONITOR), 0)
    return (stations.select(F.col("stationId").alias("station_id"), F.col("name").alias("station_name"),
                            F.col("regionId").alias("region_id"), first["channelId"].alias("channel_id"))
            .filter(F.coalesce(F.col("channel_id"), F.lit(0)) != 0))


def parse_stations(text: Column) -> Column:
    return F.from_json(text, STATION)


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """Station catalog: a JSON array of station objects."""
    return rain_channel(spark.read.schema(STATION).option("multiLine", True).json(path))


# -------------------------------------------------------- measurements

def parse_envelope(text: Column) -> Column:
    return F.from_json(text, ENVELOPE)


def api_time(c: Column) -> Column:
    return parse_time(c, API_TIME_PATTERNS)


def latest_reading(env: Column) -> Column:
    """``data[0].channels[0]`` of an envelope, or NULL when data is empty."""
    m = F.get(env["data"], 0)
    ch = F.get(m["channels"], 0)
    return F.when(m.isNotNull(), F.struct(api_time(m["datetime"]).alias("measurement_time"),
                                          ch["value"].alias("rain_amount_mm"),
                                          ch["status"].alias("status")))


def flatten_readings(df: DataFrame, env: str = "env") -> DataFrame:
    """One row per ``data[]`` element (first channel), position kept as ``pos``."""
    x = df.select("*", F.posexplode(F.col(f"{env}.data")).alias("pos", "_m")).drop(env)
    ch = F.get(F.col("_m.channels"), 0)
    return x.select(*[c for c in x.columns if c != "_m"],
                    api_time(F.col("_m.datetime")).alias("measurement_time"),
                    ch["value"].alias("rain_amount_mm"), ch["status"].alias("status"))


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Landed answers of the station API, one JSON line per station:
    station_id, env."""
    raw = spark.read.schema(LANDED_ENVELOPE).json(path)
    return raw.select(F.col("stationId").alias("station_id"), F.struct("data").alias("env"))


def read_monthly(spark: SparkSession, path: str) -> DataFrame:
    """Monthly histories (S3): one valid reading (P1) per row; the month is
    whatever was landed in ``path``."""
    return quality_filter(flatten_readings(read_envelopes(spark, path))).drop("pos")


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """Daily series (S4) as landed: station_id and env, the envelope whose
    ``data`` keeps the feed's order, for ``live.last_hour_of_series``."""
    return read_envelopes(spark, path)


# ----------------------------------------------------------- flow feed

def parse_flow_feed(text: Column) -> Column:
    return F.from_json(text, FLOW_STATION)


def read_flow_feed(spark: SparkSession, path: str) -> DataFrame:
    """One row per station with ``feed_id``, its position in the feed's array."""
    feed = F.from_json("value", ArrayType(FLOW_STATION))
    return (spark.read.text(path, wholetext=True).select(F.posexplode(feed).alias("feed_id", "s"))
            .select("feed_id", "s.*"))


# ----------------------------------------------------- XML feeds

def parse_warning(xml: Column) -> Column:
    return F.from_xml(xml, WARNING_ITEM)


def clean_warnings(items: DataFrame) -> DataFrame:
    """Missing title/description -> 'No Title' / 'No Description'; strip the
    paragraph markup and trim."""
    desc = F.coalesce(F.col("description"), F.lit("No Description"))
    desc = F.trim(F.replace(F.replace(desc, F.lit(WARNING_OPEN_TAG), F.lit("")), F.lit(WARNING_CLOSE_TAG), F.lit("")))
    return items.select("*", F.coalesce(F.col("title"), F.lit("No Title")).alias("title_clean"),
                        desc.alias("details"))


def read_warnings(spark: SparkSession, path: str) -> DataFrame:
    """Every ``item`` element of an RSS file, at any depth."""
    raw = spark.read.format("xml").option("rowTag", "item").schema(WARNING_ITEM).load(path)
    return clean_warnings(raw)


def parse_forecast_location(xml: Column) -> Column:
    return F.from_xml(xml, FORECAST_LOCATION)


def forecast_rows(locations: DataFrame, loc: str = "loc") -> DataFrame:
    """One row per forecast of each location that has metadata; a location
    without forecasts keeps one row with NULL time and 0.0 rain. Missing
    or empty rain -> 0.0; ``pos`` is the feed order inside a location."""
    x = locations.filter(F.col(f"{loc}.LocationMetaData").isNotNull())
    x = x.select("*", F.posexplode_outer(f"{loc}.LocationData.Forecast").alias("pos", "_f"))
    rain = F.coalesce(F.nullif(F.trim(F.col("_f.Rain")), F.lit("")).try_cast("double"), F.lit(0.0))
    return x.select("*", F.col(f"{loc}.LocationMetaData.LocationId").alias("location_id"),
                    F.col("_f.ForecastTime").alias("forecast_time_text"),
                    parse_time(F.col("_f.ForecastTime"), ["yyyy-MM-dd HH:mm:ss"]).alias("forecast_time"),
                    rain.alias("rain")).drop("_f")


def location_coords(locations: DataFrame, loc: str = "loc") -> DataFrame:
    """Id, English name, lat, lon. An empty coordinate is NULL on its own;
    an unparsable one makes both NULL."""
    md = F.col(f"{loc}.LocationMetaData")
    lat_t, lon_t = F.trim(md["DisplayLat"]), F.trim(md["DisplayLon"])
    lat = F.nullif(lat_t, F.lit("")).try_cast("double")
    lon = F.nullif(lon_t, F.lit("")).try_cast("double")
    bad = ((F.coalesce(lat_t, F.lit("")) != "") & lat.isNull()) | ((F.coalesce(lon_t, F.lit("")) != "") & lon.isNull())
    return (locations.filter(md.isNotNull())
            .select(md["LocationId"].alias("ims_id"), md["LocationNameEng"].alias("ims_name"),
                    F.when(bad, F.lit(None)).otherwise(lat).cast("double").alias("lat"),
                    F.when(bad, F.lit(None)).otherwise(lon).cast("double").alias("lon")))


def read_forecast(spark: SparkSession, path: str) -> DataFrame:
    """Forecast rows of a feed file; ``element`` is the position of the
    Location element in the feed (a later element overrides an earlier one
    with the same id, like a later duplicate inside one element)."""
    raw = spark.read.format("xml").option("rowTag", "Location").schema(FORECAST_LOCATION).load(path)
    locs = raw.select(F.struct(*raw.columns).alias("loc"), F.monotonically_increasing_id().alias("element"))
    return forecast_rows(locs)
