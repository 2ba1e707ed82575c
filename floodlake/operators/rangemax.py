"""Aggregates over many time windows of long series, without meeting raw rows.

The readings of a series are reduced to one row an hour (partial aggregates),
and the hours to blocks of 2, 4, 8, ... aligned hours: a tree of about twice
as many rows as hours. A window [lo, hi] is cut into its whole hours, which
are the union of at most two blocks of every size, and into the broken hours
at its two ends. So a window of n hours meets 2 log2(n) blocks in an equi-join
on (series, size, block), and the readings of two hours in one on (series,
hour). Both joins have fine-grained keys: a series that holds a third of all
readings is spread over all tasks.

Results are exact: maxima of disjoint parts, and counts that add up. Readings
without a time are in no window; a window without a reading has no row; a
window whose end is before its start, or null, is empty.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def hour_number(df: DataFrame, time: str) -> Column:
    """Whole hours since 1970; times without a zone are counted as they are
    written, whatever the zone of the session."""
    c = F.col(time)
    if df.schema[time].dataType.typeName() == "timestamp_ntz":
        return F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour(c)
    return F.floor(F.unix_seconds(c) / 3600)


def _whole(df: DataFrame, time: str) -> Column:
    """Whether a time is the first instant of its hour."""
    return F.date_trunc("hour", F.col(time)) == F.col(time)


def blocks(first: Column, end: Column) -> Column:
    """(size, block) of the aligned blocks whose disjoint union is the hours
    first .. end - 1; ``size`` k stands for 2^k hours. At every size at most
    the odd block at the left and the odd one at the right are taken."""
    steps = F.ceil(F.log2(F.greatest(end - first, F.lit(1)).cast("double"))).cast("int") + 1

    def of_size(k: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        left = F.floor((first + width - 1) / width)
        right = F.floor(end / width)
        some = left < right
        return F.array_compact(F.array(
            F.when(some & (F.pmod(left, F.lit(2)) == 1), F.struct(k.alias("size"), left.cast("long").alias("block"))),
            F.when(some & (F.pmod(right, F.lit(2)) == 1), F.struct(k.alias("size"), (right - 1).cast("long").alias("block")))))
    return F.flatten(F.transform(F.sequence(F.lit(0), steps), of_size))


def window_maxima(series: DataFrame, windows: DataFrame, values: Sequence[str], time: str, lo: str, hi: str,
                  keys: Sequence[str] = ("basin_id",), window_id: str = "event_id") -> DataFrame:
    """keys, ``window_id``, max of each of ``values`` and ``n``, the number of
    readings with lo <= time <= hi, for every row of ``windows``."""
    keys, values = list(keys), list(values)
    hourly = cut_lineage(
        series.where(F.col(time).isNotNull()).groupBy(*keys, hour_number(series, time).alias("block"))
        .agg(*[F.max(v).alias(v) for v in values], F.count(F.lit(1)).alias("n")), "hourly_maxima")
    open_ = windows.where(F.col(lo) <= F.col(hi)).select(
        *keys, window_id, lo, hi, hour_number(windows, lo).alias("_a"), hour_number(windows, hi).alias("_z"),
        _whole(windows, lo).alias("_even"))
    # whole hours: from the first one that starts in the window up to the one that hi lies in, this one left out
    first = F.when(F.col("_even"), F.col("_a")).otherwise(F.col("_a") + 1)
    inner = (open_.select(*keys, window_id, F.when(first < F.col("_z"), blocks(first, F.col("_z"))).alias("_p"))
             .select(*keys, window_id, F.explode("_p").alias("_p")).select(*keys, window_id, "_p.size", "_p.block"))
    inner = cut_lineage(inner, "window_blocks")
    # no block is larger than the widest window's largest
    top = inner.agg(F.max("size")).first()[0] or 0
    tree = (hourly.select("*", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("size"))
            .withColumn("block", F.call_function("shiftright", F.col("block"), F.col("size")))
            .groupBy(*keys, "size", "block").agg(*[F.max(v).alias(v) for v in values], F.sum("n").alias("n")))
    whole = _equal(inner, tree, [*keys, "size", "block"]).select(
        *[F.col(f"w.{c}").alias(c) for c in [*keys, window_id]], *[F.col(f"s.{c}").alias(c) for c in [*values, "n"]])
    # the hour of lo, if the window starts inside it, and the hour of hi
    ends = open_.select(*keys, window_id, lo, hi, F.explode(F.array_distinct(F.array_compact(F.array(
        F.when(~F.col("_even"), F.col("_a")), F.col("_z"))))).alias("block"))
    raw = series.select(*keys, F.col(time).alias("_t"), *values, hour_number(series, time).alias("block"))
    broken = (_equal(ends, raw, [*keys, "block"]).where(F.col("s._t").between(F.col(f"w.{lo}"), F.col(f"w.{hi}")))
              .select(*[F.col(f"w.{c}").alias(c) for c in [*keys, window_id]], *[F.col(f"s.{c}").alias(c) for c in values],
                      F.lit(1).cast("long").alias("n")))
    return (whole.unionByName(broken).groupBy(*keys, window_id)
            .agg(*[F.max(v).alias(v) for v in values], F.sum("n").alias("n")))


def _equal(windows: DataFrame, rows: DataFrame, on: Sequence[str]) -> DataFrame:
    w, s = windows.alias("w"), rows.alias("s")
    return w.join(s, reduce(and_, [F.col(f"w.{c}") == F.col(f"s.{c}") for c in on]))
