"""Flood labels, sessions, events and splits.

Series operators work per basin over hourly rows (bounded by the time
span, not by raw volume). Event windows over a series are equi-joins with
blocks of hourly maxima (``rangemax``), so a busy basin spreads over many
tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rangemax import window_maxima

# Thresholds studied for the flood stage, the event gap,
# the share of events held out and the floor on that number.
SWEEP_THRESHOLDS = [3, 5, 8, 10, 15, 20, 30, 50]
EVENT_GAP = "7 days"
TEST_EVENT_SHARE = 0.2
MIN_TEST_EVENTS = 2
ZOOM_HOURS = 72
HYDROGRAPH_DAYS = 2


def label_now(df: DataFrame, threshold: float | Column, flow: str = "flow", out: str = "is_flood") -> DataFrame:
    thr = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return df.withColumn(out, (F.col(flow) > thr).cast("int"))


def label_ahead(df: DataFrame, threshold: float | Column, horizon: int = 1, flow: str = "flow",
                keys: Sequence[str] = ("basin_id",), order: str = "hour", align: str = "row",
                out: str | None = None) -> DataFrame:
    """1 when the flow ``horizon`` rows (``align='row'``) or hours
    (``align='time'``) ahead is above the threshold; the last rows of a
    series, with nothing ahead, get 0 (not NULL)."""
    thr = threshold if isinstance(threshold, Column) else F.lit(threshold)
    name = out or f"flood_in_{horizon}h"
    w = Window.partitionBy(*keys).orderBy(order)
    if align == "row":
        ahead = F.lead(flow, horizon).over(w)
        return df.withColumn(name, F.coalesce((ahead > thr).cast("int"), F.lit(0)))
    # time alignment: the value at exactly hour + horizon, if that hour exists
    later = df.select(*keys, (F.col(order) - F.expr(f"INTERVAL {int(horizon)} HOURS")).alias(order),
                      F.col(flow).alias("_ahead"))
    return (df.join(later, list(keys) + [order], "left")
            .withColumn(name, F.coalesce((F.col("_ahead") > thr).cast("int"), F.lit(0))).drop("_ahead"))


def decide(p: str | Column, threshold: float, inclusive: bool) -> Column:
    c = F.col(p) if isinstance(p, str) else p
    return (c >= threshold if inclusive else c > threshold).cast("int")


def time_split(df: DataFrame, at: str, order: str = "hour") -> DataFrame:
    """'train' up to and including ``at``, 'test' after it."""
    return df.withColumn("split", F.when(F.col(order) <= F.lit(at).cast("timestamp_ntz"), "train")
                         .otherwise("test"))


def time_slice(df: DataFrame, start: str, end: str, order: str = "hour") -> DataFrame:
    return df.filter(F.col(order).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def row_split(df: DataFrame, frac: float = 0.8, keys: Sequence[str] = ("basin_id",),
              order: str = "hour") -> DataFrame:
    """Chronological split by row count: the first ``int(n * frac)`` rows train."""
    w = Window.partitionBy(*keys).orderBy(order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("split", F.when(F.row_number().over(w) <= F.floor(n * frac), "train").otherwise("test"))


def threshold_sweep(df: DataFrame, thresholds: Sequence[float] = SWEEP_THRESHOLDS, flow: str = "flow",
                    keys: Sequence[str] = ("basin_id",), order: str = "hour") -> DataFrame:
    """Per key and threshold: hours above it and the number of 0 -> 1
    transitions (a series that starts above adds no event). One ordered
    window and one aggregate for all thresholds."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(order)
    x = df.select(*keys, F.col(flow).alias("_f"), F.lag(flow, 1).over(w).alias("_p"))
    aggs = []
    for i, t in enumerate(thresholds):
        aggs.append(F.sum((F.col("_f") > t).cast("int")).alias(f"h{i}"))
        aggs.append(F.sum(((F.col("_f") > t) & (F.col("_p") <= t)).cast("int")).alias(f"e{i}"))
    g = x.groupBy(*keys).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"),
                              F.col(f"h{i}").cast("bigint").alias("hours_above"),
                              F.coalesce(F.col(f"e{i}"), F.lit(0)).cast("bigint").alias("events"))
                     for i, t in enumerate(thresholds)])
    return g.select(*keys, F.inline(rows))


def flood_sessions(df: DataFrame, threshold: float | Column, gap: str = EVENT_GAP, flow: str = "flow",
                   keys: Sequence[str] = ("basin_id",), order: str = "hour") -> DataFrame:
    """Flood rows (flow above threshold) numbered into events: a new event
    starts when the gap to the previous flood row is more than ``gap``
    (exactly ``gap`` stays in the event). Ids start at 0 per key.

    Rows are first reduced to (key, clock hour, first and last time): a gap
    longer than an hour can only fall between hours, so ordering the hours
    of a key is exact and never sorts a busy key's raw rows in one task.
    The ids go back to the rows with an equi-join on (key, hour).
    """
    keys = list(keys)
    thr = threshold if isinstance(threshold, Column) else F.lit(threshold)
    floods = df.filter(F.col(flow) > thr).withColumn("_hb", F.date_trunc("hour", order))  # internal key
    hours = floods.groupBy(*keys, "_hb").agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    w = Window.partitionBy(*keys).orderBy("_hb")
    prev = F.lag("_hi", 1).over(w)
    new = F.when(prev.isNotNull() & (F.col("_lo") > prev + F.expr(f"INTERVAL {gap}")), 1).otherwise(0)
    ids = (hours.withColumn("_new", new)
           .withColumn("event_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
           .select(*keys, "_hb", "event_id"))
    return floods.join(ids, keys + ["_hb"]).drop("_hb")


def flood_events(sessions: DataFrame, flow: str = "flow", keys: Sequence[str] = ("basin_id",),
                 order: str = "hour") -> DataFrame:
    return sessions.groupBy(*keys, "event_id").agg(
        F.min(order).alias("start_time"), F.max(order).alias("end_time"),
        F.count(F.lit(1)).alias("n_hours"), F.max(flow).alias("peak_flow"))


def event_cutoff(events: DataFrame, share: float = TEST_EVENT_SHARE, least: int = MIN_TEST_EVENTS,
                 keys: Sequence[str] = ("basin_id",)) -> DataFrame:
    """Hold out the last ``max(least, int(share * E))`` events; the cut is the
    last hour of event ``E - n - 1`` (NULL when there are too few events)."""
    keys = list(keys)
    n_test = F.greatest(F.lit(least), F.floor(F.col("n_events") * share).cast("int"))
    # counts first (one row a key), then the end of the cut event: both are partial aggregates
    per = (events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events"))
           .select(*keys, "n_events", n_test.cast("bigint").alias("n_test_events"), (F.col("n_events") - n_test - 1).alias("_cut")))
    ends = events.join(per, keys).groupBy(*keys).agg(F.max(F.when(F.col("event_id") == F.col("_cut"), F.col("end_time"))).alias("cutoff_time"))
    return per.join(ends, keys).select(*keys, F.col("n_events").cast("bigint").alias("n_events"), "n_test_events",
                                       F.when(F.col("_cut") >= 0, F.col("_cut")).cast("int").alias("cutoff_event"), "cutoff_time")


def peak_hydrograph(df: DataFrame, days: int = HYDROGRAPH_DAYS, flow: str = "flow",
                    keys: Sequence[str] = ("basin_id",), order: str = "hour") -> DataFrame:
    """Series within +-``days`` of the time of maximum flow (first of ties)."""
    keys = list(keys)
    peak = df.where(F.col(flow).isNotNull()).groupBy(*keys).agg(
        F.min_by(order, F.struct((-F.col(flow)).alias("f"), F.col(order).alias("t"))).alias("peak_time"))
    peak = F.broadcast(peak)  # one row per key
    lo = F.col("peak_time") - F.expr(f"INTERVAL {days} DAYS")
    hi = F.col("peak_time") + F.expr(f"INTERVAL {days} DAYS")
    return (df.join(peak, keys).filter(F.col(order).between(lo, hi))
            .select(*keys, "peak_time", order, flow))


def event_peaks(series: DataFrame, events: DataFrame, hours: int = ZOOM_HOURS,
                actual: str = "actual", predicted: str = "predicted",
                keys: Sequence[str] = ("basin_id",), order: str = "ts") -> DataFrame:
    """For each event, the peak actual and predicted value within
    [start - hours, end + hours]: hourly maxima in blocks of doubling size
    (see ``rangemax``); raw readings meet only the windows' two end hours."""
    margin = F.expr(f"INTERVAL {int(hours)} HOURS")
    windows = events.select(*keys, "event_id", (F.col("start_time") - margin).alias("_lo"),
                            (F.col("end_time") + margin).alias("_hi"))
    found = window_maxima(series, windows, [actual, predicted], order, "_lo", "_hi", keys)
    return found.select(*keys, "event_id", F.col(actual).alias("peak_actual"), F.col(predicted).alias("peak_predicted"),
                        F.col("n").alias("rows_in_window"))
