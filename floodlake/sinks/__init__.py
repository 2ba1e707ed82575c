"""Sinks (K1-K6): committed file writes instead of database statements.

Tables are parquet folders; every write is a Spark job whose output is
committed atomically, so a failed or retried task never leaves partial
rows behind.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.live import upsert_new
from ..session import read_if_there
from .versions import VersionedTable, insert_new_committed

__all__ = ["VersionedTable", "append", "insert_new", "insert_new_committed", "read_settlements", "stamp", "write_grid",
           "write_review", "write_settlements"]


def insert_new(df: DataFrame, target_path: str, stations: DataFrame,
               keys: Sequence[str] = ("station_id", "measurement_time"),
               time_col: str = "measurement_time", day_col: str = "day") -> int:
    """K1: append only registered, not-yet-stored rows (first of duplicated
    keys in the batch); returns the number of rows inserted. Running it
    twice with the same batch inserts nothing the second time.

    The stored table is partitioned by ``day``; only the days present in
    the batch are read back for the key check (see ``upsert_new``)."""
    spark = df.sparkSession
    batch = df.withColumn(day_col, F.to_date(time_col))
    existing = read_if_there(spark, target_path)
    target = existing if existing is not None else batch.limit(0)
    new = upsert_new(batch, target, stations, list(keys) + [day_col], prune_by=day_col)
    if existing is not None:
        new = new.select(*existing.columns)
    new = new.cache()  # counted and written once
    n = new.count()
    new.write.mode("append").partitionBy(day_col).parquet(target_path)
    new.unpersist()
    return n


def append(df: DataFrame, target_path: str) -> None:
    """K2: plain append, no key or station check (a rerun duplicates)."""
    df.write.mode("append").parquet(target_path)


def write_settlements(settlements: DataFrame, path: str, txn: tuple[str, int] | None = None) -> int:
    """K3: the updated settlements become the next version of the table in
    ``path``, published in one step; readers see the version before until
    then. ``settlements`` may be computed from the table itself. Returns the
    version's number."""
    return VersionedTable(settlements.sparkSession, path).replace(settlements, txn=txn)


def read_settlements(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The newest (or the given) version; None if there is none."""
    return VersionedTable(spark, path).read(version)


def write_grid(df: DataFrame, path: str, partition_by: Sequence[str] = ("basin_id",), fmt: str = "parquet") -> None:
    """K4: hourly grids and feature sets, one folder per basin."""
    df.write.mode("overwrite").partitionBy(*partition_by).format(fmt).option("header", True).save(path)


# Column names of the reviewed mapping file.
REVIEW_COLUMNS = ["IMS_ID", "IMS_Name", "Matched_DB_ID", "Matched_DB_Name", "Distance_KM", "Confidence_Score"]


def write_review(matches: DataFrame, path: str) -> None:
    """K5: the match review listing, weakest first, as one CSV file with the
    mapping file's columns and a leading byte-order mark (one row per forecast
    location, a small result); after review it is read back by
    ``files.read_mapping``."""
    cols = ["ims_id", "ims_name", "matched_id", "matched_name", "distance_km", "score"]
    out = matches.orderBy("score", "ims_id").select(*[F.col(c).alias(n) for c, n in zip(cols, REVIEW_COLUMNS)])
    # the mark stands before the header, where a spreadsheet looks for it
    marked = out.withColumnRenamed(REVIEW_COLUMNS[0], "\ufeff" + REVIEW_COLUMNS[0])
    marked.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def stamp(df: DataFrame, **cols) -> DataFrame:
    """Add constant metadata columns (run id, model version) before a write."""
    for k, v in cols.items():
        df = df.withColumn(k, F.lit(v))
    return df
