"""Raw CSV inputs (S9-S12): explicit schemas, coercing parse, no inference.

``read_*`` take file paths (many files in one read, the file name kept
from ``_metadata``); ``clean_*_lines`` apply the same parsing to a column
of raw CSV lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import station_from_file
from ..functions.timecols import FLOW_TIME_PATTERNS, RAIN_TIME_PATTERNS, parse_number, parse_time

# Column layouts of the raw files (renamed by position).
RAIN_CSV_SCHEMA = "Station STRING, DateTime STRING, Rainfall STRING"
FLOW_CSV_SCHEMA = ("Record_ID STRING, Station_Code STRING, Name_Hebrew STRING, Name_English STRING, "
                   "Hydro_Year STRING, DateTime STRING, Water_Level STRING, Flow STRING, "
                   "Measurement_Type STRING, Water_Type STRING, Segment_Status STRING")
MAPPING_CSV_SCHEMA = ("IMS_ID STRING, IMS_Name STRING, Matched_DB_ID STRING, Matched_DB_Name STRING, "
                      "Distance_KM STRING, Confidence_Score STRING")


def _clean_rain(df: DataFrame) -> DataFrame:
    """Bad number -> 0.0, bad or impossible date -> row dropped."""
    t = parse_time(F.col("DateTime"), RAIN_TIME_PATTERNS)
    return (df.withColumn("measurement_time", t).filter(F.col("measurement_time").isNotNull())
            .withColumn("rainfall", parse_number(F.col("Rainfall"), 0.0))
            .withColumn("station", F.col("Station")))


def _clean_flow(df: DataFrame) -> DataFrame:
    """Bad date -> row dropped; bad flow -> NULL (skipped by the hourly max)."""
    t = parse_time(F.col("DateTime"), FLOW_TIME_PATTERNS)
    return (df.withColumn("measurement_time", t).filter(F.col("measurement_time").isNotNull())
            .withColumn("flow", parse_number(F.col("Flow"), None))
            .withColumn("station_code", F.col("Station_Code")))


def clean_rain_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    parsed = lines.select("*", F.from_csv(F.col(line), RAIN_CSV_SCHEMA).alias("_r")).select("*", "_r.*").drop("_r")
    return _clean_rain(parsed)


def clean_flow_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    parsed = lines.select("*", F.from_csv(F.col(line), FLOW_CSV_SCHEMA).alias("_r")).select("*", "_r.*").drop("_r")
    return _clean_flow(parsed)


def read_rain_csv(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Several raw rain files (header row) as one DataFrame, duplicates kept;
    the station name comes from each file's name."""
    raw = (spark.read.option("header", True).option("mode", "PERMISSIVE").schema(RAIN_CSV_SCHEMA)
           .csv(list(paths)).withColumn("file_name", F.col("_metadata.file_name")))
    return _clean_rain(raw).withColumn("station_name", station_from_file(F.col("file_name")))


def read_flow_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    raw = spark.read.option("header", False).option("encoding", "UTF-8").schema(FLOW_CSV_SCHEMA).csv(path)
    return _clean_flow(raw)


def read_hourly(spark: SparkSession, paths: Sequence[str], suffix: str = "_Hourly_Rain_Features.csv") -> DataFrame:
    """Hourly station grids written earlier: station id from the file name,
    value columns renamed by position to rain and intensity."""
    raw = (spark.read.option("header", True).schema("DateTime STRING, c1 STRING, c2 STRING").csv(list(paths))
           .withColumn("file_name", F.col("_metadata.file_name")))
    return raw.select(
        F.regexp_replace("file_name", suffix.replace(".", r"\.") + "$", "").alias("station_id"),
        parse_time(F.col("DateTime"), ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss"]).alias("hour"),
        parse_number(F.col("c1"), None).alias("Rain"), parse_number(F.col("c2"), None).alias("Intensity"))


def read_settlements(spark: SparkSession, path: str) -> DataFrame:
    """Settlements table (S13), its five columns only (pruned at the scan)."""
    return spark.read.parquet(path).select("settlement_id", "name_eng", "name_heb", "lat", "lon")


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Review mapping CSV (the UTF-8 byte-order mark is dropped by the reader)."""
    raw = spark.read.option("header", True).schema(MAPPING_CSV_SCHEMA).csv(path)
    return raw.select(
        F.col("IMS_ID").cast("long").alias("ims_id"), F.col("IMS_Name").alias("ims_name"),
        F.col("Matched_DB_ID").try_cast("double").alias("matched_id"), F.col("Matched_DB_Name").alias("matched_name"),
        F.col("Distance_KM").try_cast("double").alias("distance_km"),
        F.col("Confidence_Score").try_cast("int").alias("score"))
