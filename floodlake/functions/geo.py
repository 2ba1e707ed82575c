"""Great-circle distance and the spatial blocking used by radius joins (F1).

Blocking: latitude bands of height >= radius; inside band j, longitude
cells of width ``360 / n_j`` where ``n_j`` is chosen so a cell is at least
as wide as the radius at the band's highest latitude (plus one band of
margin). A point then finds every partner within the radius in at most
3 x 3 (band, cell) buckets, and the join is a plain equi-join on the
bucket. Cells wrap at the antimeridian; near the poles a band is one cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Mean Earth radius (km) and the shortest length of one
# degree of latitude (km, at the equator).
EARTH_RADIUS_KM = 6371.0
KM_PER_DEG_LAT_MIN = 110.574


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in km; NULL when any coordinate is NULL."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dlat = p2 - p1
    dlon = F.radians(lon2) - F.radians(lon1)
    s1, s2 = F.sin(dlat / 2), F.sin(dlon / 2)
    a = s1 * s1 + F.cos(p1) * F.cos(p2) * s2 * s2
    return F.lit(EARTH_RADIUS_KM) * (F.lit(2.0) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a)))


def band_height(radius_km: float) -> float:
    return radius_km / KM_PER_DEG_LAT_MIN


def _half_width_deg(radius_km: float, max_abs_lat: Column) -> Column:
    """Largest longitude difference (degrees) two points at |lat| <= max_abs_lat
    can have while being within ``radius_km``."""
    r = radius_km / EARTH_RADIUS_KM
    c = F.cos(F.radians(F.least(max_abs_lat, F.lit(90.0))))
    ratio = F.when(c <= F.lit(1e-12), F.lit(2.0)).otherwise(F.lit(math.sin(r / 2)) / c)
    return F.when(ratio >= 1.0, F.lit(180.0)).otherwise(F.degrees(F.asin(ratio)) * 2)


def _band_cells(band: Column, radius_km: float) -> Column:
    """Number of longitude cells in a band (>= 1)."""
    h = band_height(radius_km)
    edge = F.greatest(F.abs(band * h), F.abs((band + 1) * h)) + h
    w = _half_width_deg(radius_km, edge)
    return F.greatest(F.floor(F.lit(360.0) / w), F.lit(1)).cast("long")


def _cell_of(lon: Column, n_cells: Column) -> Column:
    x = F.pmod(lon + 180.0, F.lit(360.0))
    return F.least(F.floor(x * n_cells / 360.0).cast("long"), n_cells - 1)


def with_home_bucket(df: DataFrame, lat: str, lon: str, radius_km: float, out: str = "_bk") -> DataFrame:
    """Add the (band, cell) bucket of each point: the build side of a radius join.
    Staged projections keep every derived value a column, so the plan stays small."""
    h = band_height(radius_km)
    x = df.select("*", F.floor(F.col(lat) / h).cast("long").alias("_band"))
    x = x.select("*", _band_cells(F.col("_band"), radius_km).alias("_n"))
    return x.select(*df.columns, F.struct(F.col("_band").alias("band"),
                                          _cell_of(F.col(lon), F.col("_n")).alias("cell")).alias(out))


def with_probe_buckets(df: DataFrame, lat: str, lon: str, radius_km: float, out: str = "_bk") -> DataFrame:
    """One row per bucket that can hold a point within ``radius_km`` of each
    point (at most 3 bands x 3 cells): the probe side of a radius join."""
    h = band_height(radius_km)
    x = df.select("*", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("_db"))
    x = x.select("*", (F.floor(F.col(lat) / h) + F.col("_db")).cast("long").alias("_band"))
    band = F.col("_band")
    edge = F.greatest(F.abs(F.col(lat)), F.abs(band * h), F.abs((band + 1) * h))
    x = x.select("*", _band_cells(band, radius_km).alias("_n"), _half_width_deg(radius_km, edge).alias("_half"))
    n, half, lo_x = F.col("_n"), F.col("_half"), F.col(lon) + 180.0
    x = x.select("*", F.floor(F.pmod(lo_x - half, F.lit(360.0)) * n / 360.0).cast("long").alias("_lo"),
                 (F.floor((lo_x + half) * n / 360.0) - F.floor((lo_x - half) * n / 360.0)).cast("long").alias("_span"))
    lo, span = F.col("_lo"), F.col("_span")
    cells = F.when((half >= 180.0) | (span + 1 >= n), F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), span), lambda k: F.pmod(lo + k, n)))
    x = x.select("*", F.explode(F.array_distinct(cells)).alias("_cell"))
    return x.select(*df.columns, F.struct(band.alias("band"), F.col("_cell").alias("cell")).alias(out))
