"""Basin-level statistics across rain stations.

A basin's stations are aligned on the union of their hours; a station
with no row in an hour counts as 0 rain and 0 intensity, and every
statistic divides by all N stations of the basin. Instead of building
the N x hours matrix, the statistics use the fact that absent stations
contribute zeros: sums and maxima come from the present rows, and the
variance adds ``(N - k) * mean^2`` for the k absent ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FLOOD_FEATURE_STATS = ["Basin_Rain_Mean", "Basin_Rain_Max", "Basin_Rain_Std", "Basin_Rain_Count",
                       "Basin_Intensity_Max", "Basin_Intensity_Mean"]


def basin_station_counts(hourly: DataFrame, basin: str = "basin_id",
                         station: str = "station_id") -> DataFrame:
    return hourly.groupBy(basin).agg(F.countDistinct(station).alias("n_stations"))


def station_align(hourly: DataFrame, basin: str = "basin_id", station: str = "station_id",
                  rain: str = "hourly_rain_sum", intensity: str = "max_10min_intensity") -> DataFrame:
    """Long form of the aligned station matrix: one row per (basin, hour,
    station of the basin), 0 where the station had no row that hour."""
    hours = hourly.select(basin, "hour").distinct()
    stations = hourly.select(basin, station).distinct()
    # the stations of one basin times its hours; the station list (bounded by
    # the station catalog) is broadcast so the hours are never shuffled by basin
    grid = hours.join(F.broadcast(stations), basin)
    return (grid.join(hourly.select(basin, station, "hour", rain, intensity),
                      [basin, station, "hour"], "left")
            .select(basin, "hour", station,
                    F.coalesce(rain, F.lit(0.0)).alias("rain"),
                    F.coalesce(intensity, F.lit(0.0)).alias("intensity")))


def basin_stats(hourly: DataFrame, basin: str = "basin_id", station: str = "station_id",
                rain: str = "hourly_rain_sum", intensity: str = "max_10min_intensity",
                stations: DataFrame | None = None) -> DataFrame:
    """Per (basin, hour): mean, max, sample std (0 for one station), number
    of stations with rain > 0, intensity max and mean over all N stations.

    N is the number of stations configured for the basin when ``stations``
    (station -> basin) is given, else the stations present in ``hourly``
    (which then reads ``hourly`` twice; materialize it first)."""
    n = basin_station_counts(stations if stations is not None else hourly, basin, station)
    cell = Window.partitionBy(basin, "hour")
    mean = F.sum(rain).over(cell) / F.col("n_stations")
    rows = (hourly.join(F.broadcast(n), basin)  # one row per basin
            .select(basin, "hour", "n_stations", rain, intensity, mean.alias("_mean"),
                    F.pow(F.col(rain) - mean, 2).alias("_dev2")))
    g = rows.groupBy(basin, "hour").agg(
        F.first("n_stations").alias("_n"),
        F.count(F.lit(1)).alias("_k"),
        F.first("_mean").alias("_mean"),
        F.sum("_dev2").alias("_ss"),
        F.max(rain).alias("_rmax"),
        F.sum(F.when(F.col(rain) > 0, 1).otherwise(0)).alias("_cnt"),
        F.max(intensity).alias("_imax"),
        F.sum(intensity).alias("_isum"),
    )
    absent = F.col("_n") - F.col("_k")
    ss = F.col("_ss") + absent * F.pow(F.col("_mean"), 2)
    return g.select(
        basin, "hour",
        F.col("_mean").alias("Basin_Rain_Mean"),
        F.when(absent > 0, F.greatest("_rmax", F.lit(0.0))).otherwise(F.col("_rmax")).alias("Basin_Rain_Max"),
        F.when(F.col("_n") > 1, F.sqrt(ss / (F.col("_n") - 1))).otherwise(F.lit(0.0)).alias("Basin_Rain_Std"),
        F.col("_cnt").cast("bigint").alias("Basin_Rain_Count"),
        F.when(absent > 0, F.greatest("_imax", F.lit(0.0))).otherwise(F.col("_imax")).alias("Basin_Intensity_Max"),
        (F.col("_isum") / F.col("_n")).alias("Basin_Intensity_Mean"),
    )


def merge_flow(stats: DataFrame, flow: DataFrame, basin: str = "basin_id") -> DataFrame:
    """Inner merge of basin statistics and hourly flow on (basin, hour)."""
    return stats.join(flow.select(basin, "hour", "flow"), [basin, "hour"], "inner")
