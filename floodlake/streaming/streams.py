"""Structured Streaming forms of the hourly poll.

Landed snapshot files are read incrementally (R1); duplicates are
suppressed within a watermark (R2) and for all time by an idempotent
``foreachBatch`` insert (K1); rolling last-hour rain (R3) and flood
sessions (R4) are event-time windows with a watermark; alerts (R5) are a
stateless filter; scoring (R6) applies a saved model per micro-batch.
Every query has its own checkpoint location under the shared checkpoint
folder, so a restarted driver resumes where it stopped.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import ml
from ..session import ensure_checkpoint_dir, read_if_there


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root, *parts, uuid.uuid4().hex)


def ingest_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
                  files_per_trigger: int | None = None) -> DataFrame:
    """Incremental read of files landed in ``path`` (explicit schema)."""
    r = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.load(path)


def event_time(df: DataFrame, col: str, out: str = "event_time") -> DataFrame:
    """Watermarks need TIMESTAMP (with zone); landed files carry TIMESTAMP_NTZ."""
    return df.withColumn(out, F.col(col).cast("timestamp"))


def dedup_stream(df: DataFrame, keys: Sequence[str], delay: str = "1 hour",
                 ts: str = "event_time") -> DataFrame:
    """Drop repeats of ``keys`` arriving within ``delay`` of each other."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def rolling_rain_stream(df: DataFrame, delay: str = "1 hour", ts: str = "event_time",
                        station: str = "station_id") -> DataFrame:
    """Rain of valid readings in 1-hour windows sliding every 10 minutes."""
    return (df.withWatermark(ts, delay)
            .groupBy(station, F.window(ts, "1 hour", "10 minutes").alias("w"))
            .agg(F.sum(F.when(F.col("status") == 1, F.col("rain_amount_mm"))).alias("rain_1h"),
                 F.count(F.lit(1)).alias("n_readings")))


def session_stream(df: DataFrame, threshold: float, gap: str = "7 days", delay: str = "1 hour",
                   ts: str = "event_time", flow: str = "flow", basin: str = "basin_id") -> DataFrame:
    """Flood sessions: readings above ``threshold`` closer than ``gap``
    (append mode: a session is emitted once the watermark passes its end)."""
    return (df.filter(F.col(flow) > threshold).withWatermark(ts, delay)
            .groupBy(basin, F.session_window(ts, gap).alias("s"))
            .agg(F.count(F.lit(1)).alias("n_readings"), F.max(flow).alias("peak_flow")))


def open_sessions(spark: SparkSession, checkpoint: str, basin: str = "basin_id") -> DataFrame:
    """The sessions that a ``session_stream`` query still holds open, read from
    the state of its last committed batch (columns as the stream's)."""
    value = spark.read.format("statestore").load(checkpoint).select("value.*")
    return value.toDF(basin, "s", "n_readings", "peak_flow")


def alert_stream(df: DataFrame, threshold: float = 5.0, value: str = "rain_amount_mm") -> DataFrame:
    """Readings at or above the threshold, as they arrive."""
    return df.filter(F.col(value) >= threshold)


def run_available(stream: DataFrame, out_path: str, mode: str = "append",
                  batch_fn: Callable[[DataFrame, int], None] | None = None,
                  checkpoint: str | None = None) -> None:
    """Process everything landed so far (``availableNow``) and stop.
    Without ``batch_fn`` each micro-batch is one ``batch_id=N`` folder of
    ``out_path``; a batch that is run again replaces its folder, so every row
    is there once."""
    ck = checkpoint or out_path.rstrip("/") + "_checkpoint"
    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", ck)
         .trigger(availableNow=True).foreachBatch(batch_fn or batch_folder(out_path)).start())
    q.awaitTermination()


def batch_folder(out_path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: write the batch as ``batch_id=N`` under ``out_path``."""
    def fn(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}")
    return fn


def latest_by_key(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Final state of an update-mode sink: the row of the last batch per key."""
    df = spark.read.parquet(path)
    others = [c for c in df.columns if c not in keys and c != "batch_id"]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch_id").alias("_r"))
            .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others]))


def idempotent_insert(target_path: str, keys: Sequence[str], time_col: str = "measurement_time",
                      day_col: str = "day") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: append only rows whose keys the target lacks
    (all-time uniqueness; replaying a batch adds nothing). The target is
    partitioned by day and matched on it, so each micro-batch reads only
    the days it touches."""
    def fn(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = batch.withColumn(day_col, F.to_date(time_col)).dropDuplicates(list(keys))
        existing = read_if_there(spark, target_path)
        if existing is not None:
            days = F.broadcast(first.select(day_col).distinct())   # days of this micro-batch
            existing = existing.select(*keys, day_col).join(days, day_col, "left_semi")    # pruned to those partitions
            first = first.join(existing, list(keys) + [day_col], "left_anti")
        first.write.mode("append").partitionBy(day_col).parquet(target_path)
    return fn


def score_batches(model, bundle: ml.Bundle, out_path: str,
                  keep: Sequence[str] = ("basin_id", "hour")) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: score a micro-batch through a model and its
    bundle as ``ml.score`` does (features aligned by name, a missing one 0.0)
    and write probability and decision as that batch's folder."""
    write = batch_folder(out_path)

    def fn(batch: DataFrame, batch_id: int) -> None:
        write(ml.score(batch, model, bundle, keep), batch_id)
    return fn
