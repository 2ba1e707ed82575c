"""Live-cycle operators: latest reading, last-hour rain, idempotent insert,
live flow peaks and basin routing (A4, A5, J8, J9, K1, O5, W12, P4).

Top-1 per key is a partial aggregate (``max_by`` over a total order),
not a sorted window, so a station with a huge share of the rows is
reduced map-side before any shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import last_updated, unescape_unicode
from .quality import fill_defaults, registered

LAST_HOUR_ROWS = 6


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row with the largest ``order`` tuple per key (ties broken by the
    later order columns)."""
    keys = list(keys)
    others = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in others])


def last_hour_rain(df: DataFrame, keys: Sequence[str] = ("station_id", "day"),
                   order: str | Sequence[str] = "pos", rows: int = LAST_HOUR_ROWS) -> DataFrame:
    """Sum of the readings with status 1 among the last ``rows`` entries of
    each series (filter after taking; sentinels are not excluded); a series
    without rows is simply absent (the caller treats it as 0.0). ``order``
    may list tie-breaking columns after the position."""
    keys = list(keys)
    order = [order] if isinstance(order, str) else list(order)
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    last = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= rows)
    return last.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("status") == 1, F.col("rain_amount_mm"))), F.lit(0.0)).alias("last_hour_rain"),
        F.count(F.lit(1)).alias("n_taken"))


def last_hour_of_series(series: DataFrame, env: str = "env", rows: int = LAST_HOUR_ROWS) -> DataFrame:
    """A4 on landed daily series (``feeds.read_daily``): the last ``rows``
    entries of the feed's array by position, status 1 only; a series without
    entries (empty, null or unreadable) has 0.0. One row per input row, no
    shuffle: the order is the array's own."""
    data = F.coalesce(F.col(f"{env}.data"), F.array().cast(series.schema[env].dataType["data"].dataType))
    last = F.slice(data, F.greatest(F.size(data) - rows + 1, F.lit(1)), F.lit(rows))
    value = lambda m: F.get(m["channels"], 0)
    rain = F.aggregate(last, F.lit(0.0), lambda acc, m: acc + F.when(
        value(m)["status"] == 1, F.coalesce(value(m)["value"], F.lit(0.0))).otherwise(0.0))
    return series.select(*[c for c in series.columns if c != env], rain.alias("last_hour_rain"),
                         F.size(last).cast("long").alias("n_taken"))


def upsert_new(df: DataFrame, target: DataFrame, stations: DataFrame,
               keys: Sequence[str] = ("station_id", "measurement_time"), order: str = "event_id",
               prune_by: str | None = None) -> DataFrame:
    """Rows an idempotent insert would add: registered stations only, the
    first of duplicated keys in the batch (by ``order``), and nothing
    whose key is already in ``target`` (ON CONFLICT DO NOTHING).

    ``prune_by`` names a partition column of ``target`` (a day): the stored
    table is first cut to the batch's values of it with a semi-join on the
    broadcast set of those values (a few hundred per year at most), which
    Spark prunes to those partitions, so a poll never scans all history."""
    keys = list(keys)
    batch = registered(fill_defaults(df), stations)
    first = latest_per_key(batch.withColumn("_o", -F.col(order)), keys, ["_o"]).drop("_o")
    stored = target.select(*keys)
    if prune_by is not None:
        stored = stored.join(F.broadcast(batch.select(prune_by).distinct()), prune_by, "left_semi")
    return first.join(stored, keys, "left_anti")


# ------------------------------------------------------------- live flow

def first_valid_obs(feed: DataFrame) -> DataFrame:
    """Per feed station: its first observation with a non-empty flow
    (array order), name decoded from ``\\uXXXX`` escapes."""
    obs = F.get(F.filter("obs", lambda o: o["flow"].isNotNull() & (o["flow"] != "")), 0)
    return (feed.select("*", unescape_unicode(F.col("name")).alias("raw_name"), obs.alias("_o"))
            .filter(F.col("_o").isNotNull())
            .select(*[c for c in feed.columns if c not in ("name", "obs")], "raw_name",
                    F.col("_o.flow").try_cast("double").alias("flow_m3s"),
                    last_updated(F.col("_o.date"), F.col("_o.time")).alias("last_updated")))


def basin_peak_flow(first_obs: DataFrame, names: DataFrame, order: str = "feed_id") -> DataFrame:
    """Map raw station names to sub-basins (unmapped dropped) and keep the
    largest flow per sub-basin with its time and raw name; on equal flows
    the station earlier in the feed (``order``) wins."""
    # an unparsable flow is no flow; the names are a fixed-size dimension
    mapped = first_obs.where(F.col("flow_m3s").isNotNull()).join(F.broadcast(names), "raw_name")
    g = mapped.groupBy("sub_basin").agg(F.min_by(
        F.struct("flow_m3s", "last_updated", "raw_name"),
        F.struct((-F.col("flow_m3s")).alias("f"), F.col(order).alias("o"))).alias("_b"))
    return g.select("sub_basin", F.col("_b.flow_m3s").alias("flow_m3s"),
                    F.col("_b.last_updated").alias("last_updated"), F.col("_b.raw_name").alias("raw_name"))


def route_basin(df: DataFrame, routing: DataFrame, key: str = "sub_basin") -> DataFrame:
    """Attach the model basin of each sub-basin (NULL when not routed)."""
    return df.join(F.broadcast(routing), key, "left")

