"""Flow statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import selection

# The quantiles reported for the flood-stage study and the
# flood level used in the grid profile.
DISTRIBUTION_PROBS = [0.5, 0.95, 0.99, 0.999]
PROFILE_FLOOD_LEVEL = 5.0


def flow_distribution(df: DataFrame, flow: str = "flow", keys: Sequence[str] = ("basin_id",),
                      approx: bool = False, accuracy: int = 100000) -> DataFrame:
    """Mean, median, p95, p99, p99.9 (linear interpolation) and max.

    The quantiles are exact, by ``selection`` (no task holds the values of a
    basin); ``approx=True`` takes one pass of ``percentile_approx``.
    """
    g = df.groupBy(*keys).agg(F.avg(flow).alias("mean_flow"), F.max(flow).alias("max_flow"),
                              *([F.percentile_approx(flow, DISTRIBUTION_PROBS, accuracy).alias("q")] if approx else []))
    if not approx:
        df = cut_lineage(df.select(*keys, flow), "flow_values")
        g = (df.groupBy(*keys).agg(F.avg(flow).alias("mean_flow"), F.max(flow).alias("max_flow"))
             .join(selection.quantiles(df, flow, DISTRIBUTION_PROBS, keys), list(keys), "left"))
    return g.select(*keys, "mean_flow",
                    F.col("q")[0].cast("double").alias("median_flow"),
                    F.col("q")[1].cast("double").alias("p95_flow"),
                    F.col("q")[2].cast("double").alias("p99_flow"),
                    F.col("q")[3].cast("double").alias("p999_flow"),
                    "max_flow")


def flow_duration(df: DataFrame, flow: str = "flow", keys: Sequence[str] = ("basin_id",),
                  order: str = "hour") -> DataFrame:
    """Flow-duration curve: flows sorted descending, exceedance = rank / n * 100
    (tied flows get distinct ranks)."""
    w = Window.partitionBy(*keys).orderBy(F.col(flow).desc(), F.col(order))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.select(*keys, F.row_number().over(w).cast("bigint").alias("rank"),
                     (F.row_number().over(w) / n * 100).alias("exceedance_pct"), F.col(flow).alias("flow"))


def grid_profile(df: DataFrame, flow: str = "flow", keys: Sequence[str] = ("basin_id",),
                 order: str = "hour", level: float = PROFILE_FLOOD_LEVEL) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_hours"), F.min(order).alias("first_hour"), F.max(order).alias("last_hour"),
        F.max(flow).alias("max_flow"),
        F.sum((F.col(flow) > level).cast("int")).cast("bigint").alias("hours_over_level"))


def dataset_profile(features: DataFrame, feature_names: Sequence[str], flow: str = "flow",
                    keys: Sequence[str] = ("basin_id",), order: str = "hour") -> DataFrame:
    """Profile of a feature dataset: hours, range, max flow, feature count."""
    return features.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_hours"), F.min(order).alias("first_hour"), F.max(order).alias("last_hour"),
        F.max(flow).alias("max_flow"), F.lit(len(feature_names)).cast("int").alias("n_features"))
