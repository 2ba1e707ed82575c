"""Adapter views that give the driver's tables the shape of rain, flow,
station, settlement, forecast and score feeds.

The same SQL text runs in Spark (tables bound as DataFrame parameters of
``spark.sql``) and in DuckDB (tables are pre-registered views), so the
oracle and the Spark job start from identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .session import table_path

# view name -> (base tables it reads, SQL text with {table} placeholders)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    # 6 stations in 2 basins, sentinel -9999, bad status rows, dry spell on days 10-16
    "v_rain": (("events",), """
        SELECT event_id, CAST(user_id % 6 AS INT) AS station_id, CAST(user_id % 2 AS INT) AS basin_id,
               ts AS measurement_time,
               CASE WHEN event_id % 97 = 0 THEN CAST(-9999 AS DOUBLE)
                    WHEN day(ts) BETWEEN 10 AND 16 THEN CAST(0 AS DOUBLE)
                    ELSE value / CAST(25 AS DOUBLE) END AS rain_amount_mm,
               CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS status
        FROM {events}"""),
    # irregular flow readings per basin
    "v_flow": (("events",), """
        SELECT CAST(user_id % 2 AS INT) AS basin_id, ts AS measurement_time,
               value / CAST(10 AS DOUBLE) AS flow
        FROM {events} WHERE event_type IN ('view', 'click', 'purchase')"""),
    # registered stations 0-4 (station 5 is unregistered)
    "v_stations": (("supplier",), """
        SELECT CAST(s_suppkey AS INT) AS station_id, s_name AS station_name, s_nationkey AS region_id
        FROM {supplier} WHERE s_suppkey < 5"""),
    "v_settlements": (("part",), """
        SELECT p_partkey AS settlement_id, p_name AS name_eng,
               CAST(29.5 AS DOUBLE) + ((p_partkey * 7919) % 3800) / CAST(1000 AS DOUBLE) AS lat,
               CAST(34.3 AS DOUBLE) + ((p_partkey * 104729) % 1400) / CAST(1000 AS DOUBLE) AS lon
        FROM {part}"""),
    # shifted twin of a settlement, damaged name, every 7th without latitude
    "v_locations": (("supplier", "part"), """
        SELECT s.s_suppkey AS ims_id, replace(p.p_name, 'e', '') AS ims_name,
               CASE WHEN s.s_suppkey % 7 = 0 THEN NULL
                    ELSE CAST(29.5 AS DOUBLE) + ((s.s_suppkey * 7919 + 13) % 3800) / CAST(1000 AS DOUBLE) END AS lat,
               CAST(34.3 AS DOUBLE) + ((s.s_suppkey * 104729 + 13) % 1400) / CAST(1000 AS DOUBLE) AS lon
        FROM {supplier} s JOIN {part} p ON p.p_partkey = s.s_suppkey"""),
    # windows at 3, 9, 15, 21; missing rain; duplicates per (location, time), last pos wins
    "v_forecast": (("orders",), """
        SELECT CAST(o_custkey % 120 AS INT) AS location_id,
               o_orderdate + CAST(3 + 6 * (o_orderkey % 4) AS INT) * INTERVAL '1' HOUR AS forecast_time,
               o_orderkey AS pos,
               CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice / CAST(100000 AS DOUBLE) END AS rain
        FROM {orders}"""),
    # deterministic label / probability / regression pair (ties present)
    "v_scored": (("events",), """
        SELECT event_id, CAST(user_id % 2 AS INT) AS basin_id, ts,
               value / CAST(10 AS DOUBLE) AS actual,
               (value / CAST(10 AS DOUBLE)) * CAST(0.8 AS DOUBLE) + (event_id % 13) / CAST(4 AS DOUBLE) AS predicted,
               CASE WHEN value > 100 THEN 1 ELSE 0 END AS label,
               ((event_id * 37) % 100) / CAST(200 AS DOUBLE)
                 + CASE WHEN value > 100 THEN CAST(0.3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS proba
        FROM {events}"""),
}


# The driver's tables are read-only, so the lazy readers and view plans are
# built once per Spark application (file listing and schema inference
# included) and reused by every query; no data is cached.
_PLANS: dict[tuple, DataFrame] = {}


def _memo(spark: SparkSession, key: tuple, make) -> DataFrame:
    try:
        app = spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001 - remote session: key by the session only
        app = None
    k = (id(spark), app) + key
    if k not in _PLANS:
        _PLANS[k] = make()
    return _PLANS[k]


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _memo(spark, ("base", sf_dir, name), lambda: spark.read.parquet(table_path(sf_dir, name)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Spark DataFrame of one adapter view over ``sf_dir``."""
    tables, sql = VIEWS[name]
    return _memo(spark, ("view", sf_dir, name),
                 lambda: spark.sql(sql, **{t: base(spark, sf_dir, t) for t in tables}))


def duck_view_sql(name: str) -> str:
    tables, sql = VIEWS[name]
    return sql.format(**{t: t for t in tables})


def with_views(*names: str) -> str:
    """``WITH`` clause defining the given adapter views for DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS ({duck_view_sql(n)})" for n in names) + "\n"
