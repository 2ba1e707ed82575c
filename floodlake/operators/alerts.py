"""Alert text built with column expressions.

Every record becomes one line on its executor; the header is a global
count (partial counts per task, one tiny final merge). Nothing is
concatenated into a single value, so the digest scales with the input:
its lines come out ordered by ``sort_key``, by a distributed sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Message templates of the alert and warning digests.
ALERT_HEADER = "Found %d records exceeding %smm:"
ALERT_LINE = "- Station '%s' at %s: %smm"
ALERT_NONE = "No stations recorded rainfall above %smm."
WARNINGS_NONE = "No active warnings currently in the IMS feed."
WARNINGS_FOUND = "Active IMS Warnings found:"
WARNINGS_ITEM = "- Title: %s\n  Details: %s\n"
TIME_TEXT = "yyyy-MM-dd HH:mm:ss"


def alert_digest(rows: DataFrame, threshold: float) -> DataFrame:
    """Header line (count, or the all-clear message) plus one line per
    reading: columns ``sort_key`` (NULL for the header, else the rain) and ``line``."""
    thr = str(float(threshold))
    lines = rows.select(
        F.col("rain_amount_mm").alias("sort_key"),
        F.format_string(ALERT_LINE, F.col("station_name"), F.date_format("measurement_time", TIME_TEXT),
                        F.col("rain_amount_mm").cast("string")).alias("line"))
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    header = n.select(F.lit(None).cast("double").alias("sort_key"),
                      F.when(F.col("n") > 0, F.format_string(ALERT_HEADER, F.col("n"), F.lit(thr)))
                      .otherwise(F.lit(ALERT_NONE % thr)).alias("line"))
    # the header first, then the heaviest rain
    return header.unionByName(lines).orderBy(F.col("sort_key").desc_nulls_first(), "line")


def warning_parts(items: DataFrame) -> DataFrame:
    """Color, type (title case), regions and timeframe of each cleaned warning."""
    title = F.col("title_clean")
    return items.select(
        "*",
        F.initcap(F.regexp_extract(title, r"^\s*(\w+)", 1)).alias("color"),
        F.initcap(F.lower(F.trim(F.regexp_extract(title, r"-\s*(.*)$", 1)))).alias("warning_type"),
        F.trim(F.regexp_extract("details", r"Regions:\s*([^.]*)", 1)).alias("regions"),
        F.trim(F.regexp_extract("details", r"Timeframe:\s*(.*)$", 1)).alias("timeframe"))


def warnings_digest(items: DataFrame, as_of_date: str) -> DataFrame:
    """Markdown digest: a '# date' header (or the no-warnings message) and
    one '## Color - Type / Regions / Timeframe' block per warning."""
    parts = warning_parts(items)
    blocks = parts.select(F.col("item_id").cast("long").alias("sort_key"), F.format_string(
        "## %s - %s\nRegions: %s\nTimeframe: %s", "color", "warning_type", "regions", "timeframe").alias("block"))
    n = items.agg(F.count(F.lit(1)).alias("n"))
    header = n.select(F.lit(None).cast("long").alias("sort_key"),
                      F.when(F.col("n") > 0, F.lit(f"# {as_of_date}")).otherwise(F.lit(WARNINGS_NONE)).alias("block"))
    return header.unionByName(blocks).orderBy(F.col("sort_key").asc_nulls_first())


def warnings_list(items: DataFrame) -> DataFrame:
    """The cleaned warnings as text, in feed order: title, then details."""
    blocks = items.select(F.col("item_id").cast("long").alias("sort_key"),
                          F.format_string(WARNINGS_ITEM, "title_clean", "details").alias("block"))
    n = items.agg(F.count(F.lit(1)).alias("n"))
    header = n.select(F.lit(None).cast("long").alias("sort_key"),
                      F.when(F.col("n") > 0, F.lit(WARNINGS_FOUND)).otherwise(F.lit(WARNINGS_NONE)).alias("block"))
    return header.unionByName(blocks).orderBy(F.col("sort_key").asc_nulls_first())
