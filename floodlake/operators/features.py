"""Model features over the merged (basin, hour) table.

All shifts are by row within a basin, ordered by hour. Every feature
window shares ``partitionBy(basin).orderBy(hour)`` so Spark plans one
exchange and one sort for the whole feature set.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The feature set and its order, as the models consume it.
FLOW_LAGS = [1, 2, 3, 6, 12, 24]
RAIN_LAGS = [1, 2, 3, 4, 5, 6]
ROLLING_HOURS = [24, 72, 168]
EWM_ALPHA = 0.02
ACTIVE_FLOW = 0.1
SUSPICIOUS_FLOW = 4.0
SUSPICIOUS_RAIN_24H = 1.0
FEATURE_NAMES = [
    "Basin_Rain_Mean", "Basin_Rain_Max", "Basin_Rain_Std", "Basin_Rain_Count",
    "Basin_Intensity_Max", "Basin_Intensity_Mean",
    "Flow_lag1h", "Flow_lag2h", "Flow_lag3h", "Flow_lag6h", "Flow_lag12h", "Flow_lag24h",
    "Flow_Rate_of_Change", "Flow_Is_Active",
    "Soil_Moisture_EWM", "Rolling_Rain_24h", "Rolling_Rain_72h", "Rolling_Rain_168h",
    "Basin_Rain_lag1h", "Basin_Intensity_lag1h", "Basin_Rain_lag2h", "Basin_Intensity_lag2h",
    "Basin_Rain_lag3h", "Basin_Intensity_lag3h", "Basin_Rain_lag4h", "Basin_Intensity_lag4h",
    "Basin_Rain_lag5h", "Basin_Intensity_lag5h", "Basin_Rain_lag6h", "Basin_Intensity_lag6h",
    "Rain_Acceleration", "Month_Sin", "Month_Cos", "Hour_Sin", "Hour_Cos",
    "Is_Early_Winter", "Is_Peak_Winter", "Is_Summer",
]
FLOW_FEATURES = ["Flow_lag1h", "Flow_lag2h", "Flow_lag3h", "Flow_lag6h", "Flow_lag12h",
                 "Flow_lag24h", "Flow_Rate_of_Change", "Flow_Is_Active"]

#: rows of an EWM block at most; the weights inside must stay in a double's range
EWM_BLOCK, EWM_EXPONENT = 512, 600.0


def ewm_block(alpha: float) -> int:
    """Rows of a block whose weights (1 - alpha)^-p stay below e^600."""
    return EWM_BLOCK if alpha <= 0 else 1 if alpha >= 1 else max(1, min(EWM_BLOCK, int(EWM_EXPONENT / -math.log1p(-alpha))))


def series_window(keys: Sequence[str] = ("basin_id",), order: str = "hour") -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def lag_columns(col: str, offsets: Iterable[int], prefix: str,
                keys: Sequence[str] = ("basin_id",)) -> list[Column]:
    w = series_window(keys)
    return [F.lag(col, n).over(w).alias(f"{prefix}{n}h") for n in offsets]


def diff(col: str, keys: Sequence[str] = ("basin_id",)) -> Column:
    return F.col(col) - F.lag(col, 1).over(series_window(keys))


def active_flag(col: str, threshold: float = ACTIVE_FLOW, keys: Sequence[str] = ("basin_id",)) -> Column:
    """1 when the previous row is above ``threshold``; NULL counts as 0."""
    prev = F.lag(col, 1).over(series_window(keys))
    return F.coalesce((prev > threshold).cast("int"), F.lit(0))


def rolling_sum(col: str, rows: int, shift: int = 1, keys: Sequence[str] = ("basin_id",)) -> Column:
    """Sum of the ``rows`` values ending ``shift`` rows back; NULL until the
    window is full (a NULL inside the window also makes it NULL)."""
    w = series_window(keys).rowsBetween(-(rows - 1) - shift, -shift)
    return F.when(F.count(col).over(w) == rows, F.sum(col).over(w))


def _over(keys: Sequence[str], order: str = "hour", frame: str = "") -> str:
    part = ", ".join(f"`{k}`" for k in keys)
    return f"OVER (PARTITION BY {part} ORDER BY `{order}`{(' ' + frame) if frame else ''})"


# The bulk feature projections are written as SQL expressions: one parse in
# the JVM per column instead of many Python-to-JVM calls per Column, which
# keeps plan construction cheap. They mean exactly what the Column helpers
# above build.

def flow_features(df: DataFrame, flow: str = "flow", keys: Sequence[str] = ("basin_id",)) -> DataFrame:
    w = _over(keys)
    exprs = [f"lag(`{flow}`, {n}) {w} AS Flow_lag{n}h" for n in FLOW_LAGS]
    exprs.append(f"`{flow}` - lag(`{flow}`, 1) {w} AS Flow_Rate_of_Change")
    exprs.append(f"coalesce(CAST(lag(`{flow}`, 1) {w} > {ACTIVE_FLOW!r}D AS INT), 0) AS Flow_Is_Active")
    return df.select("*", *[F.expr(e) for e in exprs])


def ewm(df: DataFrame, col: str, out: str, alpha: float = EWM_ALPHA, shift: int = 1,
        keys: Sequence[str] = ("basin_id",), order: str = "hour", block: int | None = None) -> DataFrame:
    """Exponentially weighted mean, ``adjust=False`` (y0 = x0,
    y_t = (1-a) y_{t-1} + a x_t), shifted ``shift`` rows.

    Blocked prefix scan: inside a block of ``block`` rows the weights stay
    in range (``(1-a)^-p``); the value carried into each block comes from
    a short per-series fold over block ends (rows / block entries).
    """
    keys = list(keys)
    beta = 1.0 - alpha
    block = block or ewm_block(alpha)
    w = Window.partitionBy(*keys).orderBy(order)
    r = F.row_number().over(w) - 1
    x = df.select("*", r.alias("_r"), F.floor(r / block).alias("_blk"), (r % block).alias("_p"))
    v = F.when(F.col("_r") == 0, F.col(col)).otherwise(F.col(col) * alpha)
    wb = (Window.partitionBy(*keys, "_blk").orderBy("_r")
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = x.withColumn("_loc", F.pow(beta, F.col("_p")) * F.sum(v * F.pow(beta, -F.col("_p"))).over(wb))
    ends = (x.groupBy(*keys, "_blk")
            .agg(F.max_by("_loc", "_p").alias("L"), F.count(F.lit(1)).alias("n")))
    # carry into block k = value at the end of block k-1 (a short fold per series)
    fold = F.expr(
        "aggregate(array_sort(collect_list(struct(_blk, L, n))), "
        "named_struct('c', CAST(array() AS ARRAY<DOUBLE>), 'y', CAST(0 AS DOUBLE)), "
        f"(acc, e) -> named_struct('c', concat(acc.c, array(acc.y)), 'y', pow({beta!r}D, e.n) * acc.y + e.L)).c")
    carries = (ends.groupBy(*keys).agg(fold.alias("_c"))
               .select(*keys, F.posexplode("_c").alias("_blk", "_carry")))
    y = F.col("_loc") + F.pow(beta, F.col("_p") + 1) * F.coalesce("_carry", F.lit(0.0))
    joined = x.join(carries, keys + ["_blk"], "left")
    keep = [c for c in df.columns]
    if shift:
        return joined.select(*keep, F.lag(y, shift).over(w).alias(out))
    return joined.select(*keep, y.alias(out))


def seasonality(ts: str = "hour") -> list[Column]:
    m = F.month(ts)
    h = F.hour(ts)
    two_pi = 2 * 3.141592653589793
    return [
        F.sin(two_pi * m / 12).alias("Month_Sin"),
        F.cos(two_pi * m / 12).alias("Month_Cos"),
        F.sin(two_pi * h / 24).alias("Hour_Sin"),
        F.cos(two_pi * h / 24).alias("Hour_Cos"),
        m.isin(10, 11).cast("int").alias("Is_Early_Winter"),
        m.isin(12, 1, 2).cast("int").alias("Is_Peak_Winter"),
        m.isin(6, 7, 8, 9).cast("int").alias("Is_Summer"),
    ]


def rain_features(df: DataFrame, keys: Sequence[str] = ("basin_id",), extra: Sequence[Column] = ()) -> DataFrame:
    """Rolling rain, rain and intensity lags, acceleration, seasonality;
    soil moisture is added by ``ewm`` (it needs its own block windows).
    ``extra`` columns ride along in the same projection."""
    w = _over(keys)
    exprs = []
    for n in ROLLING_HOURS:
        fw = _over(keys, frame=f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING")
        exprs.append(f"CASE WHEN count(Basin_Rain_Mean) {fw} = {n} THEN sum(Basin_Rain_Mean) {fw} END "
                     f"AS Rolling_Rain_{n}h")
    for n in RAIN_LAGS:
        exprs.append(f"lag(Basin_Rain_Mean, {n}) {w} AS Basin_Rain_lag{n}h")
        exprs.append(f"lag(Basin_Intensity_Max, {n}) {w} AS Basin_Intensity_lag{n}h")
    exprs.append(f"Basin_Rain_Mean - lag(Basin_Rain_Mean, 1) {w} AS Rain_Acceleration")
    two_pi = f"{2 * 3.141592653589793!r}D"
    exprs += [f"sin({two_pi} * month(hour) / 12) AS Month_Sin", f"cos({two_pi} * month(hour) / 12) AS Month_Cos",
              f"sin({two_pi} * hour(hour) / 24) AS Hour_Sin", f"cos({two_pi} * hour(hour) / 24) AS Hour_Cos",
              "CAST(month(hour) IN (10, 11) AS INT) AS Is_Early_Winter",
              "CAST(month(hour) IN (12, 1, 2) AS INT) AS Is_Peak_Winter",
              "CAST(month(hour) IN (6, 7, 8, 9) AS INT) AS Is_Summer"]
    return df.select("*", *[F.expr(e) for e in exprs], *extra)


def suspicious_hours(flow: str = "flow", flow_min: float = SUSPICIOUS_FLOW,
                     rain_max: float = SUSPICIOUS_RAIN_24H, hours: int = 24,
                     keys: Sequence[str] = ("basin_id",)) -> Column:
    """High flow with (almost) no rain over the ``hours`` rows ending at the
    current one; a window that is not yet full is never suspicious."""
    rain_window = rolling_sum("Basin_Rain_Mean", hours, 0, keys)
    return F.coalesce((F.col(flow) > flow_min) & (rain_window < rain_max), F.lit(False))


def raw_features(merged: DataFrame, keys: Sequence[str] = ("basin_id",)) -> DataFrame:
    """All 38 features on the merged table, before filtering (pass 1)."""
    df = ewm(merged, "Basin_Rain_Mean", "Soil_Moisture_EWM", keys=keys)
    df = rain_features(df, keys)
    return flow_features(df, "flow", keys)


def clean_features(merged: DataFrame, keys: Sequence[str] = ("basin_id",)) -> DataFrame:
    """Null the flow of suspicious hours, build the flow features from the
    nulled flow, then drop every row with a NULL (lead-in rows included).

    Flow features are built once, after nulling: the first-pass values
    would be overwritten anyway.
    """
    keys = list(keys)
    df = ewm(merged, "Basin_Rain_Mean", "Soil_Moisture_EWM", keys=keys)
    df = rain_features(df, keys, extra=[
        F.when(~suspicious_hours("flow", keys=keys), F.col("flow")).alias("_flow2")])
    df = flow_features(df.drop("flow").withColumnRenamed("_flow2", "flow"), "flow", keys)
    cols = keys + ["hour"] + FEATURE_NAMES + ["flow"]
    return df.select(*cols).dropna("any", subset=FEATURE_NAMES + ["flow"])


def clean_audit(before: DataFrame, after: DataFrame, flow_min: float = SUSPICIOUS_FLOW,
                keys: Sequence[str] = ("basin_id",)) -> DataFrame:
    """Rows before/after/removed per basin and the high-flow hours left in
    months 4-9 (expected 0)."""
    keys = list(keys)
    b = before.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_before"))
    a = after.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows_after"),
        F.sum(F.when((F.col("flow") > flow_min) & F.month("hour").between(4, 9), 1).otherwise(0))
        .cast("bigint").alias("summer_high_flow"))
    return (b.join(a, keys, "left")
            .select(*keys, "rows_before",
                    F.coalesce("rows_after", F.lit(0)).cast("bigint").alias("rows_after"),
                    (F.col("rows_before") - F.coalesce("rows_after", F.lit(0))).cast("bigint").alias("rows_removed"),
                    F.coalesce("summer_high_flow", F.lit(0)).cast("bigint").alias("summer_high_flow")))
