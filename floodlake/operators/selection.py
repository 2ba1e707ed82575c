"""Exact order statistics of many series at once, in bounded memory.

Selection by narrowing: every wanted rank of a series has an interval of
values that still holds it. One aggregate counts the values of all open
intervals in ``buckets`` equal parts (a row lies in one interval at most, and
partial counts are combined in every task first), the part with the rank
becomes the next interval, shrunk to the smallest and largest value seen in
it. An interval of one value is done; once all open ones hold ``few`` values
or less, these are fetched sorted. No task ever holds the values or the
distinct values of a series.

Nulls and NaN are left out, and so are rows without a key; a series without
values has no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BUCKETS, FEW = 256, 4096


def _bucket(v: Column, lo: Column, hi: Column, buckets: int) -> Column:
    """The part of [lo, hi] that holds v; the two ends have one each, so an
    interval of two values or more always becomes smaller."""
    inner = F.floor((v - lo) / (hi - lo) * (buckets - 2))
    return (F.when(v == lo, 0).when(v == hi, buckets - 1)
            .otherwise(1 + F.least(F.greatest(F.coalesce(inner, F.lit(0)), F.lit(0)), F.lit(buckets - 3)))).cast("int")


def order_statistics(df: DataFrame, value: str, ranks: Column, keys: Sequence[str] = ("basin_id",),
                     buckets: int = BUCKETS, few: int = FEW) -> DataFrame:
    """keys, rank, value: the values at the (zero-based) ranks that the
    expression ``ranks`` lists from ``n``, the number of the series' values.
    ``df`` is read once per step, so pass a table that is cheap to read."""
    keys = list(keys)
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    size = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    state = cut_lineage(size.select(*keys, F.explode(F.array_distinct(ranks)).alias("rank"), "lo", "hi",
                                    F.lit(0).cast("long").alias("below"), F.col("n").alias("held")), "selection")
    while True:
        most = state.where("lo < hi").agg(F.max("held")).first()[0] or 0
        if most <= few:
            break
        hist = (_inside(rows, state, keys)
                .groupBy(*keys, "lo", "hi", _bucket(F.col("_v"), F.col("lo"), F.col("hi"), buckets).alias("_b"))
                .agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
        w = Window.partitionBy(*keys, "lo", "hi").orderBy("_b")     # at most ``buckets`` rows
        hist = hist.withColumn("_end", F.sum("_n").over(w))
        open_ = state.where("lo < hi").drop("held")
        place = F.col("rank") - F.col("below")
        nxt = (open_.join(hist, [*keys, "lo", "hi"])
               .where((place < F.col("_end")) & (place >= F.col("_end") - F.col("_n")))
               .select(*keys, "rank", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"),
                       (F.col("below") + F.col("_end") - F.col("_n")).alias("below"), F.col("_n").alias("held")))
        state = cut_lineage(state.where("lo = hi").unionByName(nxt), "selection")
    done = state.where("lo = hi").select(*keys, "rank", F.col("lo").alias("value"))
    if not most:
        return done
    last = (_inside(rows, state, keys)
            .groupBy(*keys, "lo", "hi").agg(F.array_sort(F.collect_list("_v")).alias("_all")))     # ``few`` values at most
    found = (state.where("lo < hi").join(last, [*keys, "lo", "hi"])
             .select(*keys, "rank", F.get("_all", (F.col("rank") - F.col("below")).cast("int")).alias("value")))
    return done.unionByName(found)


def _inside(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the open interval that holds them; the others go. A series
    has at most one interval a rank, equal or apart from each other. They are
    written, so that Spark knows their size."""
    spans = cut_lineage(state.where("lo < hi").select(*keys, "lo", "hi").distinct(), "selection_spans")
    return rows.join(spans, keys).where(F.col("_v").between(F.col("lo"), F.col("hi"))).select(*keys, "_v", "lo", "hi")


def quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = ("basin_id",),
              buckets: int = BUCKETS, few: int = FEW) -> DataFrame:
    """keys, n, q: the quantiles by linear interpolation between neighbours,
    in the order of ``probs``."""
    keys = list(keys)
    at = F.array(*[F.lit(float(p)) * (F.col("n") - 1) for p in probs])
    ranks = F.concat(F.transform(at, lambda x: F.floor(x)), F.transform(at, lambda x: F.ceil(x)))
    found = order_statistics(df, value, ranks, keys, buckets, few)
    listed = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_m"))
    v = F.col(value).cast("double")
    size = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys).agg(F.count("*").alias("n"))

    def part(x: Column) -> Column:
        low, high = F.col("_m")[F.floor(x)], F.col("_m")[F.ceil(x)]
        return low + (high - low) * (x - F.floor(x))
    return listed.join(size, keys).select(*keys, "n", F.transform(at, part).alias("q"))
