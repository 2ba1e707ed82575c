"""DuckDB oracle SQL for the registered queries.

Each string is self-contained: it defines the adapter views it needs as
CTEs over the pre-registered base tables and computes the expected result
in plain SQL, written independently of the Spark operators (e.g. basin
statistics over the dense station matrix, EWM as a recursive CTE).
Doubles are rounded to 6 decimals, as on the Spark side.
"""

from __future__ import annotations

from ..fixtures import duck_view_sql

ORACLES: dict[str, str] = {}

# Shared CTE fragments (name -> body). Order matters: later ones read earlier ones.
FRAG: dict[str, str] = {
    "rain_q": "SELECT * FROM v_rain WHERE rain_amount_mm >= 0 AND status = 1",
    "hr_agg": """SELECT basin_id, station_id, date_trunc('hour', measurement_time) AS hour,
                        sum(rain_amount_mm) AS s, max(rain_amount_mm) AS mx
                 FROM rain_q GROUP BY basin_id, station_id, date_trunc('hour', measurement_time)""",
    "hr": """SELECT g.basin_id, g.station_id, g.hour,
                    coalesce(a.s, 0) AS hourly_rain_sum, coalesce(a.mx, 0) AS max_10min_intensity
             FROM (SELECT basin_id, station_id, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour
                   FROM hr_agg GROUP BY basin_id, station_id) g
             LEFT JOIN hr_agg a ON a.basin_id = g.basin_id AND a.station_id = g.station_id AND a.hour = g.hour""",
    "fl_agg": """SELECT basin_id, date_trunc('hour', measurement_time) AS hour, max(flow) AS f
                 FROM v_flow GROUP BY basin_id, date_trunc('hour', measurement_time)""",
    "fl": """SELECT g.basin_id, g.hour,
                    coalesce(last_value(a.f IGNORE NULLS) OVER (PARTITION BY g.basin_id ORDER BY g.hour
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS flow
             FROM (SELECT basin_id, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour
                   FROM fl_agg GROUP BY basin_id) g
             LEFT JOIN fl_agg a ON a.basin_id = g.basin_id AND a.hour = g.hour""",
    "dense": """SELECT h.basin_id, h.hour, s.station_id,
                       coalesce(r.hourly_rain_sum, 0) AS rain, coalesce(r.max_10min_intensity, 0) AS inten
                FROM (SELECT DISTINCT basin_id, hour FROM hr) h
                JOIN (SELECT DISTINCT basin_id, station_id FROM hr) s ON s.basin_id = h.basin_id
                LEFT JOIN hr r ON r.basin_id = h.basin_id AND r.station_id = s.station_id AND r.hour = h.hour""",
    "bstats": """SELECT basin_id, hour, avg(rain) AS Basin_Rain_Mean, max(rain) AS Basin_Rain_Max,
                        coalesce(stddev_samp(rain), 0) AS Basin_Rain_Std,
                        CAST(sum(CASE WHEN rain > 0 THEN 1 ELSE 0 END) AS BIGINT) AS Basin_Rain_Count,
                        max(inten) AS Basin_Intensity_Max, avg(inten) AS Basin_Intensity_Mean
                 FROM dense GROUP BY basin_id, hour""",
    "m": """SELECT b.*, f.flow FROM bstats b JOIN fl f ON f.basin_id = b.basin_id AND f.hour = b.hour""",
    "eb": """SELECT basin_id, hour, Basin_Rain_Mean AS x,
                    row_number() OVER (PARTITION BY basin_id ORDER BY hour) - 1 AS r FROM m""",
    "ewm_rec": """SELECT basin_id, r, x AS y FROM eb WHERE r = 0
                  UNION ALL
                  SELECT e.basin_id, e.r, CAST(0.98 AS DOUBLE) * p.y + CAST(0.02 AS DOUBLE) * e.x
                  FROM ewm_rec p JOIN eb e ON e.basin_id = p.basin_id AND e.r = p.r + 1""",
    "ewm": """SELECT eb.basin_id, eb.hour,
                     lag(w.y, 1) OVER (PARTITION BY eb.basin_id ORDER BY eb.r) AS Soil_Moisture_EWM
              FROM eb JOIN ewm_rec w ON w.basin_id = eb.basin_id AND w.r = eb.r""",
}
FRAG_DEPS: dict[str, tuple[str, ...]] = {
    "rain_q": ("v_rain",), "hr_agg": ("rain_q",), "hr": ("hr_agg",),
    "fl_agg": ("v_flow",), "fl": ("fl_agg",),
    "dense": ("hr",), "bstats": ("dense",), "m": ("bstats", "fl"),
    "eb": ("m",), "ewm_rec": ("eb",), "ewm": ("ewm_rec",),
}
VIEW_NAMES = {"v_rain", "v_flow", "v_stations", "v_settlements", "v_locations", "v_forecast", "v_scored"}


def _closure(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for dep in FRAG_DEPS.get(n, ()):
            visit(dep)
        out.append(n)

    for n in names:
        visit(n)
    return out


def sql(body: str, *needs: str) -> str:
    """Prefix ``body`` with the CTEs for ``needs`` and their dependencies."""
    parts = []
    for n in _closure(needs):
        text = duck_view_sql(n) if n in VIEW_NAMES else FRAG[n]
        parts.append(f"{n} AS ({text})")
    head = "WITH RECURSIVE " if "ewm_rec" in _closure(needs) else "WITH "
    return (head + ",\n".join(parts) + "\n" + body) if parts else body


def oracle(name: str, body: str, *needs: str) -> None:
    ORACLES[name] = sql(body, *needs)


def r6(expr: str, alias: str) -> str:
    return f"(round({expr}, 6) + 0.0) AS {alias}"


FLOW_LAGS = [1, 2, 3, 6, 12, 24]

# ------------------------------------------------------------------ slice 1
oracle("quality_filter", f"""
SELECT event_id, station_id, basin_id, measurement_time, {r6('rain_amount_mm', 'rain_amount_mm')}, status
FROM rain_q""", "rain_q")

oracle("high_rainfall", f"""
SELECT coalesce(s.station_name, printf('station-%d', r.station_id)) AS station_name,
       r.measurement_time, {r6('r.rain_amount_mm', 'rain_amount_mm')}
FROM v_rain r LEFT JOIN v_stations s ON s.station_id = r.station_id
WHERE r.rain_amount_mm >= 5.0""", "v_rain", "v_stations")

oracle("hourly_rain", f"""
SELECT basin_id, station_id, hour, {r6('hourly_rain_sum', 'hourly_rain_sum')},
       {r6('max_10min_intensity', 'max_10min_intensity')} FROM hr""", "hr")

oracle("hourly_flow", f"SELECT basin_id, hour, {r6('flow', 'flow')} FROM fl", "fl")

oracle("hour_grid", """
SELECT g.basin_id, g.hour, CAST(coalesce(a.n, 0) AS BIGINT) AS n_readings
FROM (SELECT basin_id, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour
      FROM (SELECT basin_id, date_trunc('hour', measurement_time) AS hour FROM v_flow) GROUP BY basin_id) g
LEFT JOIN (SELECT basin_id, date_trunc('hour', measurement_time) AS hour, count(*) AS n
           FROM v_flow GROUP BY ALL) a ON a.basin_id = g.basin_id AND a.hour = g.hour""", "v_flow")

oracle("station_align", f"""
SELECT basin_id, hour, station_id, {r6('rain', 'rain')}, {r6('inten', 'intensity')} FROM dense""", "dense")

oracle("basin_stats", f"""
SELECT basin_id, hour, {r6('Basin_Rain_Mean', 'Basin_Rain_Mean')}, {r6('Basin_Rain_Max', 'Basin_Rain_Max')},
       {r6('Basin_Rain_Std', 'Basin_Rain_Std')}, Basin_Rain_Count,
       {r6('Basin_Intensity_Max', 'Basin_Intensity_Max')}, {r6('Basin_Intensity_Mean', 'Basin_Intensity_Mean')}
FROM bstats""", "bstats")

oracle("features_base", f"""
SELECT basin_id, hour, {r6('Basin_Rain_Mean', 'Basin_Rain_Mean')}, {r6('Basin_Rain_Max', 'Basin_Rain_Max')},
       {r6('Basin_Rain_Std', 'Basin_Rain_Std')}, Basin_Rain_Count,
       {r6('Basin_Intensity_Max', 'Basin_Intensity_Max')}, {r6('Basin_Intensity_Mean', 'Basin_Intensity_Mean')},
       {r6('flow', 'flow')}
FROM m""", "m")

_W = "OVER (PARTITION BY basin_id ORDER BY hour)"
_flow_lags = ", ".join(r6(f"lag(flow, {n}) {_W}", f"Flow_lag{n}h") for n in FLOW_LAGS)
oracle("lag_features", f"""
SELECT basin_id, hour, {r6('flow', 'flow')}, {_flow_lags},
       {r6(f'flow - lag(flow, 1) {_W}', 'Flow_Rate_of_Change')},
       coalesce(CAST(lag(flow, 1) {_W} > 0.1 AS INTEGER), 0) AS Flow_Is_Active
FROM m""", "m")

oracle("diff_features", f"""
SELECT basin_id, hour, {r6(f'flow - lag(flow, 1) {_W}', 'Flow_Rate_of_Change')},
       {r6(f'Basin_Rain_Mean - lag(Basin_Rain_Mean, 1) {_W}', 'Rain_Acceleration')}
FROM m""", "m")


def _roll(n: int, shift: int = 1, col: str = "Basin_Rain_Mean") -> str:
    frame = (f"OVER (PARTITION BY basin_id ORDER BY hour ROWS BETWEEN {n - 1 + shift} PRECEDING AND "
             + (f"{shift} PRECEDING)" if shift else "CURRENT ROW)"))
    return f"CASE WHEN count({col}) {frame} = {n} THEN sum({col}) {frame} END"


oracle("rolling_rain", f"""
SELECT basin_id, hour, {r6(_roll(24), 'Rolling_Rain_24h')}, {r6(_roll(72), 'Rolling_Rain_72h')},
       {r6(_roll(168), 'Rolling_Rain_168h')}
FROM m""", "m")

oracle("soil_moisture", f"SELECT basin_id, hour, {r6('Soil_Moisture_EWM', 'Soil_Moisture_EWM')} FROM ewm", "ewm")

_SEASON = """sin(2 * pi() * month(hour) / 12) AS Month_Sin, cos(2 * pi() * month(hour) / 12) AS Month_Cos,
       sin(2 * pi() * hour(hour) / 24) AS Hour_Sin, cos(2 * pi() * hour(hour) / 24) AS Hour_Cos,
       CAST(month(hour) IN (10, 11) AS INTEGER) AS Is_Early_Winter,
       CAST(month(hour) IN (12, 1, 2) AS INTEGER) AS Is_Peak_Winter,
       CAST(month(hour) IN (6, 7, 8, 9) AS INTEGER) AS Is_Summer"""
oracle("seasonality", f"""
SELECT basin_id, hour, {r6('Month_Sin', 'Month_Sin')}, {r6('Month_Cos', 'Month_Cos')},
       {r6('Hour_Sin', 'Hour_Sin')}, {r6('Hour_Cos', 'Hour_Cos')}, Is_Early_Winter, Is_Peak_Winter, Is_Summer
FROM (SELECT basin_id, hour, {_SEASON} FROM fl)""", "fl")

oracle("suspicious_hours", f"""
SELECT basin_id, hour, {r6('flow', 'flow')}
FROM (SELECT *, {_roll(24, 0)} AS roll24 FROM m) WHERE flow > 4.0 AND roll24 < 1.0""", "m")

_rain_lags = ",\n       ".join(
    f"lag(Basin_Rain_Mean, {n}) {_W} AS Basin_Rain_lag{n}h, lag(Basin_Intensity_Max, {n}) {_W} AS Basin_Intensity_lag{n}h"
    for n in range(1, 7))
FEATURES_CLEAN_BODY = f"""
, p1 AS (
  SELECT m.*, e.Soil_Moisture_EWM,
         {_roll(24)} AS Rolling_Rain_24h, {_roll(72)} AS Rolling_Rain_72h, {_roll(168)} AS Rolling_Rain_168h,
         {_rain_lags},
         Basin_Rain_Mean - lag(Basin_Rain_Mean, 1) {_W} AS Rain_Acceleration,
         {_SEASON},
         CASE WHEN flow > 4.0 AND {_roll(24, 0)} < 1.0 THEN NULL ELSE flow END AS flow2
  FROM m JOIN ewm e USING (basin_id, hour)
), p2 AS (
  SELECT *, {', '.join(f'lag(flow2, {n}) {_W} AS Flow_lag{n}h' for n in FLOW_LAGS)},
         flow2 - lag(flow2, 1) {_W} AS Flow_Rate_of_Change,
         coalesce(CAST(lag(flow2, 1) {_W} > 0.1 AS INTEGER), 0) AS Flow_Is_Active
  FROM p1
), fc AS (SELECT * FROM p2 WHERE {{notnull}})
"""
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
_INT_FEATURES = {"Basin_Rain_Count", "Flow_Is_Active", "Is_Early_Winter", "Is_Peak_Winter", "Is_Summer"}
FEATURES_CLEAN_BODY = FEATURES_CLEAN_BODY.replace(
    "{notnull}", " AND ".join(f"{c} IS NOT NULL" for c in FEATURE_NAMES + ["flow2"]))
_fc_cols = ", ".join(c if c in _INT_FEATURES else r6(c, c) for c in FEATURE_NAMES)


def _features_clean(body: str) -> str:
    return sql(FEATURES_CLEAN_BODY.lstrip() + body, "m", "ewm")


ORACLES["features_clean"] = _features_clean(f"SELECT basin_id, hour, {_fc_cols}, {r6('flow2', 'flow')} FROM fc")
ORACLES["dataset_profile"] = _features_clean(f"""
SELECT basin_id, count(*) AS n_hours, min(hour) AS first_hour, max(hour) AS last_hour,
       {r6('max(flow2)', 'max_flow')}, CAST(38 AS INTEGER) AS n_features FROM fc GROUP BY basin_id""")
ORACLES["clean_audit"] = _features_clean("""
SELECT b.basin_id, b.rows_before, coalesce(a.rows_after, 0) AS rows_after,
       b.rows_before - coalesce(a.rows_after, 0) AS rows_removed,
       coalesce(a.summer_high_flow, 0) AS summer_high_flow
FROM (SELECT basin_id, count(*) AS rows_before FROM m GROUP BY basin_id) b
LEFT JOIN (SELECT basin_id, count(*) AS rows_after,
                  CAST(sum(CASE WHEN flow2 > 4.0 AND month(hour) BETWEEN 4 AND 9 THEN 1 ELSE 0 END) AS BIGINT)
                    AS summer_high_flow
           FROM fc GROUP BY basin_id) a ON a.basin_id = b.basin_id""")

# ------------------------------------------------------ events and stats
FRAG.update({
    "fs": """SELECT basin_id, hour, flow, CAST(sum(nw) OVER (PARTITION BY basin_id ORDER BY hour
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS event_id
             FROM (SELECT basin_id, hour, flow,
                          CASE WHEN hour - lag(hour) OVER (PARTITION BY basin_id ORDER BY hour) > INTERVAL 7 DAY
                               THEN 1 ELSE 0 END AS nw
                   FROM fl WHERE flow > 25.0)""",
    "fe": """SELECT basin_id, event_id, min(hour) AS start_time, max(hour) AS end_time,
                    count(*) AS n_hours, max(flow) AS peak_flow FROM fs GROUP BY basin_id, event_id""",
    "lab": """SELECT basin_id, hour, flow,
                     coalesce(CAST(lead(flow, 1) OVER (PARTITION BY basin_id ORDER BY hour) > 25.0 AS INTEGER), 0)
                       AS flood_in_1h FROM fl""",
    "pl": """SELECT *, CASE WHEN proba > 0.3 THEN 1 ELSE 0 END AS pred FROM v_scored""",
})
FRAG_DEPS.update({"fs": ("fl",), "fe": ("fs",), "lab": ("fl",), "pl": ("v_scored",)})

oracle("flow_distribution", f"""
SELECT basin_id, {r6('avg(flow)', 'mean_flow')}, {r6('quantile_cont(flow, 0.5)', 'median_flow')},
       {r6('quantile_cont(flow, 0.95)', 'p95_flow')}, {r6('quantile_cont(flow, 0.99)', 'p99_flow')},
       {r6('quantile_cont(flow, 0.999)', 'p999_flow')}, {r6('max(flow)', 'max_flow')}
FROM fl GROUP BY basin_id""", "fl")

oracle("threshold_sweep", """
SELECT basin_id, CAST(t.thr AS DOUBLE) AS threshold,
       CAST(sum(CASE WHEN f > t.thr THEN 1 ELSE 0 END) AS BIGINT) AS hours_above,
       CAST(sum(CASE WHEN f > t.thr AND p <= t.thr THEN 1 ELSE 0 END) AS BIGINT) AS events
FROM (SELECT basin_id, flow AS f, lag(flow) OVER (PARTITION BY basin_id ORDER BY hour) AS p FROM fl) x,
     (SELECT unnest([3, 5, 8, 10, 15, 20, 30, 50]) AS thr) t
GROUP BY basin_id, t.thr""", "fl")

oracle("flood_sessions", f"SELECT basin_id, hour, {r6('flow', 'flow')}, event_id FROM fs", "fs")

oracle("flood_events", f"""
SELECT basin_id, event_id, start_time, end_time, n_hours, {r6('peak_flow', 'peak_flow')} FROM fe""", "fe")

oracle("event_cutoff", """
SELECT p.basin_id, p.n AS n_events, p.nt AS n_test_events,
       CASE WHEN p.n - p.nt - 1 >= 0 THEN CAST(p.n - p.nt - 1 AS DOUBLE) END AS cutoff_event,
       e.end_time AS cutoff_time
FROM (SELECT basin_id, count(*) AS n, CAST(greatest(2, floor(count(*) * 0.2)) AS BIGINT) AS nt
      FROM fe GROUP BY basin_id) p
LEFT JOIN fe e ON e.basin_id = p.basin_id AND e.event_id = p.n - p.nt - 1""", "fe")

oracle("peak_hydrograph", f"""
SELECT f.basin_id, pk.peak_time, f.hour, {r6('f.flow', 'flow')}
FROM fl f
JOIN (SELECT f2.basin_id, min(f2.hour) AS peak_time
      FROM fl f2 JOIN (SELECT basin_id, max(flow) AS m FROM fl GROUP BY basin_id) mx
        ON mx.basin_id = f2.basin_id AND f2.flow = mx.m
      GROUP BY f2.basin_id) pk ON pk.basin_id = f.basin_id
WHERE f.hour BETWEEN pk.peak_time - INTERVAL 2 DAY AND pk.peak_time + INTERVAL 2 DAY""", "fl")

oracle("row_split", """
SELECT basin_id, hour,
       CASE WHEN row_number() OVER (PARTITION BY basin_id ORDER BY hour)
                 <= floor(count(*) OVER (PARTITION BY basin_id) * 0.8) THEN 'train' ELSE 'test' END AS split
FROM fl""", "fl")

oracle("flow_duration", f"""
SELECT basin_id, rnk AS rank, {r6('rnk / n * 100', 'exceedance_pct')}, {r6('flow', 'flow')}
FROM (SELECT basin_id, flow, row_number() OVER (PARTITION BY basin_id ORDER BY flow DESC, hour) AS rnk,
             count(*) OVER (PARTITION BY basin_id) AS n FROM fl)""", "fl")

oracle("grid_profile", f"""
SELECT basin_id, count(*) AS n_hours, min(hour) AS first_hour, max(hour) AS last_hour,
       {r6('max(flow)', 'max_flow')}, CAST(sum(CASE WHEN flow > 5.0 THEN 1 ELSE 0 END) AS BIGINT) AS hours_over_level
FROM fl GROUP BY basin_id""", "fl")

oracle("time_split", """
SELECT basin_id, hour, CASE WHEN hour <= TIMESTAMP '2024-01-20 00:00:00' THEN 'train' ELSE 'test' END AS split
FROM fl""", "fl")

oracle("label_now", f"""
SELECT basin_id, hour, {r6('flow', 'flow')}, CAST(flow > 25.0 AS INTEGER) AS is_flood FROM fl""", "fl")

oracle("label_ahead", f"SELECT basin_id, hour, {r6('flow', 'flow')}, flood_in_1h FROM lab", "lab")

oracle("class_balance", f"""
SELECT basin_id, count(*) AS rows, CAST(sum(flood_in_1h) AS BIGINT) AS positives,
       {r6('sum(flood_in_1h) * CAST(100 AS DOUBLE) / count(*)', 'positive_pct')},
       {r6('(count(*) - sum(flood_in_1h)) / greatest(sum(flood_in_1h), 1)', 'scale_pos_weight')}
FROM lab WHERE hour <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY basin_id""", "lab")

# ----------------------------------------------------------- metrics
oracle("flood_decision", f"""
SELECT event_id, basin_id, {r6('proba', 'proba')},
       CAST(proba >= 0.5 AS INTEGER) AS decision_v1, CAST(proba > 0.3 AS INTEGER) AS decision_v3,
       CAST(proba >= 0.03 AS INTEGER) AS alert
FROM v_scored""", "v_scored")

oracle("class_weights", f"""
SELECT c.basin_id, c.label, c.n_class, {r6('t.n / (2.0 * c.n_class)', 'balanced_weight')},
       {r6('CASE WHEN c.label = 1 THEN (t.n - t.pos) / greatest(t.pos, 1) ELSE 1.0 END', 'boost_weight')}
FROM (SELECT basin_id, label, count(*) AS n_class FROM v_scored GROUP BY basin_id, label) c
JOIN (SELECT basin_id, count(*) AS n, sum(label) AS pos FROM v_scored GROUP BY basin_id) t
  ON t.basin_id = c.basin_id""", "v_scored")

oracle("confusion", """
SELECT b.basin_id, g.actual, g.predicted,
       CAST(count(p.basin_id) AS BIGINT) AS n
FROM (SELECT DISTINCT basin_id FROM pl) b
CROSS JOIN (SELECT CAST(a AS INTEGER) AS actual, CAST(q AS INTEGER) AS predicted
            FROM (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS q)) g
LEFT JOIN pl p ON p.basin_id = b.basin_id AND p.label = g.actual AND p.pred = g.predicted
GROUP BY b.basin_id, g.actual, g.predicted""", "pl")

_PRF = """
, cnt AS (SELECT basin_id, count(*) AS n,
                 sum(CASE WHEN label = 0 AND pred = 0 THEN 1 ELSE 0 END) AS c00,
                 sum(CASE WHEN label = 0 AND pred = 1 THEN 1 ELSE 0 END) AS c01,
                 sum(CASE WHEN label = 1 AND pred = 0 THEN 1 ELSE 0 END) AS c10,
                 sum(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END) AS c11 FROM pl GROUP BY basin_id)
, pc AS (SELECT basin_id, n, '0' AS class,
                coalesce(c00 / nullif(c00 + c10, 0), 0) AS precision,
                coalesce(c00 / nullif(c00 + c01, 0), 0) AS recall, c00 + c01 AS support FROM cnt
         UNION ALL
         SELECT basin_id, n, '1' AS class,
                coalesce(c11 / nullif(c11 + c01, 0), 0) AS precision,
                coalesce(c11 / nullif(c11 + c10, 0), 0) AS recall, c10 + c11 AS support FROM cnt)
, pf AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pc)
"""
oracle("class_report", _PRF.lstrip() + f"""
SELECT basin_id, class, {r6('precision', 'precision')}, {r6('recall', 'recall')}, {r6('f1', 'f1')},
       CAST(support AS BIGINT) AS support FROM pf
UNION ALL
SELECT basin_id, 'accuracy', NULL, NULL, {r6('(c00 + c11) / n', 'f1')}, CAST(n AS BIGINT) FROM cnt
UNION ALL
SELECT basin_id, 'macro avg', {r6('avg(precision)', 'p')}, {r6('avg(recall)', 'r')}, {r6('avg(f1)', 'f')},
       CAST(max(n) AS BIGINT) FROM pf GROUP BY basin_id
UNION ALL
SELECT basin_id, 'weighted avg', {r6('sum(precision * support) / max(n)', 'p')},
       {r6('sum(recall * support) / max(n)', 'r')}, {r6('sum(f1 * support) / max(n)', 'f')},
       CAST(max(n) AS BIGINT) FROM pf GROUP BY basin_id""", "pl")
# the body above starts with ", cnt AS": it continues the WITH list of pl
ORACLES["class_report"] = ORACLES["class_report"].replace("\n, cnt AS", ", cnt AS", 1)

oracle("roc_auc", f"""
SELECT basin_id,
       {r6('(sum(CASE WHEN label = 1 THEN avg_rank END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label)))', 'roc_auc')},
       CAST(sum(label) AS BIGINT) AS positives, CAST(count(*) - sum(label) AS BIGINT) AS negatives
FROM (SELECT basin_id, label,
             rank() OVER (PARTITION BY basin_id ORDER BY proba)
               + (count(*) OVER (PARTITION BY basin_id, proba) - 1) / 2.0 AS avg_rank
      FROM v_scored)
GROUP BY basin_id""", "v_scored")

oracle("regression_metrics", f"""
SELECT basin_id, count(*) AS n, {r6('avg(abs(e))', 'mae')}, {r6('sqrt(avg(e * e))', 'rmse')},
       {r6('1 - sum(e * e) / sum((actual - mu) * (actual - mu))', 'r2')}
FROM (SELECT basin_id, actual, actual - greatest(predicted, 0) AS e,
             avg(actual) OVER (PARTITION BY basin_id) AS mu FROM v_scored)
GROUP BY basin_id""", "v_scored")

oracle("flood_metrics", f"""
SELECT basin_id, CAST(sum(r) AS BIGINT) AS flood_hours, CAST(sum(r * h) AS BIGINT) AS true_pos,
       CAST(sum(r) - sum(r * h) AS BIGINT) AS false_neg, CAST(sum((1 - r) * h) AS BIGINT) AS false_pos,
       {r6('coalesce(sum(r * h) * 100.0 / nullif(sum(r), 0), 0)', 'recall_pct')},
       {r6('coalesce(sum(CASE WHEN r = 1 THEN abs(actual - p) END) / nullif(sum(r), 0), 0)', 'flood_mae')}
FROM (SELECT basin_id, actual, greatest(predicted, 0) AS p,
             CASE WHEN actual > 25.0 THEN 1 ELSE 0 END AS r,
             CASE WHEN greatest(predicted, 0) > 25.0 THEN 1 ELSE 0 END AS h FROM v_scored)
GROUP BY basin_id""", "v_scored")

oracle("event_peaks", f"""
, sf AS (SELECT basin_id, ts, CAST(sum(nw) OVER (PARTITION BY basin_id ORDER BY ts
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS event_id
         FROM (SELECT basin_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY basin_id ORDER BY ts) > INTERVAL 7 DAY
                                        THEN 1 ELSE 0 END AS nw
               FROM v_scored WHERE actual > 25.0))
, ev AS (SELECT basin_id, event_id, min(ts) AS st, max(ts) AS en FROM sf GROUP BY basin_id, event_id)
SELECT e.basin_id, e.event_id, {r6('max(s.actual)', 'peak_actual')}, {r6('max(s.predicted)', 'peak_predicted')},
       count(*) AS rows_in_window
FROM ev e JOIN v_scored s ON s.basin_id = e.basin_id
 AND s.ts BETWEEN e.st - INTERVAL 72 HOUR AND e.en + INTERVAL 72 HOUR
GROUP BY e.basin_id, e.event_id""".lstrip(), "v_scored")

# ------------------------------------------------- matching and forecast


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (f"sin((radians({lat2}) - radians({lat1})) / 2) * sin((radians({lat2}) - radians({lat1})) / 2)"
         f" + cos(radians({lat1})) * cos(radians({lat2})) * sin((radians({lon2}) - radians({lon1})) / 2)"
         f" * sin((radians({lon2}) - radians({lon1})) / 2)")
    return f"(6371.0 * (2 * atan2(sqrt({a}), sqrt(1 - ({a})))))"


def lcs(a: str, b: str) -> str:
    return f"""(CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE
  list_reduce(string_split({a}, ''),
     lambda row, ch: list_reduce(range(1, length({b}) + 1),
         lambda acc, j: list_append(acc, CASE WHEN substr({b}, j, 1) = ch THEN row[j] + 1
                                              ELSE greatest(row[j + 1], acc[j]) END), [0]),
     list_transform(range(0, length({b}) + 1), lambda x: 0))[-1] END)"""


def score(a: str, b: str) -> str:
    la, lb = f"lower(coalesce({a}, ''))", f"lower(coalesce({b}, ''))"
    return (f"(CASE WHEN length({la}) = 0 OR length({lb}) = 0 THEN 0 ELSE "
            f"CAST(round_even(200.0 * {lcs(la, lb)} / (length({la}) + length({lb})), 0) AS INTEGER) END)")


FRAG.update({
    "tw": """SELECT l.*, s.settlement_id, s.name_eng, s.lat AS s_lat, s.lon AS s_lon
             FROM v_locations l JOIN v_settlements s ON s.settlement_id = l.ims_id""",
    "gp": f"""SELECT l.ims_id, s.settlement_id, s.name_eng, {hav('l.lat', 'l.lon', 's.lat', 's.lon')} AS d
              FROM v_locations l, v_settlements s
              WHERE {hav('l.lat', 'l.lon', 's.lat', 's.lon')} <= 5.0""",
    "gs": """SELECT g.*, {sc} AS score FROM gp g JOIN v_locations l ON l.ims_id = g.ims_id""",
    "gb": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ims_id ORDER BY score DESC, d, settlement_id) AS rn
                           FROM gs) WHERE rn = 1""",
    "gm": """SELECT l.ims_id, l.ims_name, CAST(b.settlement_id AS DOUBLE) AS matched_id,
                    coalesce(b.name_eng, 'NO MATCH FOUND') AS matched_name,
                    round(b.d, 2) AS distance_km, coalesce(b.score, 0) AS score
             FROM v_locations l LEFT JOIN gb b ON b.ims_id = l.ims_id""",
    "fa": """SELECT f.*, a.as_of,
                    date_trunc('day', a.as_of - INTERVAL 3 HOUR)
                      + to_hours(CAST(floor(hour(a.as_of - INTERVAL 3 HOUR) / 6) * 6 + 3 AS BIGINT)) AS cur_w
             FROM v_forecast f JOIN (SELECT location_id, max(forecast_time) - INTERVAL 5 HOUR AS as_of
                                     FROM v_forecast GROUP BY location_id) a ON a.location_id = f.location_id""",
    "pk": """SELECT l.location_id,
                    coalesce((SELECT coalesce(c.rain, 0) FROM fa c WHERE c.location_id = l.location_id
                              AND c.forecast_time = c.cur_w ORDER BY c.pos DESC LIMIT 1), 0) AS current_rain,
                    coalesce((SELECT coalesce(c.rain, 0) FROM fa c WHERE c.location_id = l.location_id
                              AND c.forecast_time = c.cur_w + INTERVAL 6 HOUR ORDER BY c.pos DESC LIMIT 1), 0) AS next_rain
             FROM (SELECT DISTINCT location_id FROM v_forecast) l""",
    "mc": """SELECT CAST(ims_id AS VARCHAR) AS ims_key, CAST(CAST(matched_id AS DOUBLE) AS INTEGER) AS settlement_id,
                    score, distance_km, ims_id FROM gm WHERE matched_id IS NOT NULL""",
    "fm": """SELECT m.settlement_id, m.score, m.distance_km, m.ims_id, p.current_rain, p.next_rain
             FROM mc m JOIN pk p ON CAST(p.location_id AS VARCHAR) = m.ims_key""",
})
FRAG["gs"] = FRAG["gs"].replace("{sc}", score("l.ims_name", "g.name_eng"))
FRAG_DEPS.update({"tw": ("v_locations", "v_settlements"), "gp": ("v_locations", "v_settlements"),
                  "gs": ("gp",), "gb": ("gs",), "gm": ("gb",), "fa": ("v_forecast",), "pk": ("fa",),
                  "mc": ("gm",), "fm": ("mc", "pk")})

oracle("haversine", f"""
SELECT ims_id, settlement_id, (round({hav('lat', 'lon', 's_lat', 's_lon')}, 2) + 0.0) AS distance_km FROM tw""", "tw")
oracle("name_score", f"SELECT ims_id, ims_name, name_eng, {score('ims_name', 'name_eng')} AS score FROM tw", "tw")
oracle("geo_match", f"""
SELECT ims_id, ims_name, matched_id, matched_name, {r6('distance_km', 'distance_km')}, score FROM gm""", "gm")
oracle("mapping_clean", f"SELECT settlement_id, score, {r6('distance_km', 'distance_km')}, ims_id FROM mc", "mc")
oracle("forecast_windows", """
SELECT event_id, measurement_time,
       strftime(date_trunc('day', measurement_time - INTERVAL 3 HOUR)
                + to_hours(CAST(floor(hour(measurement_time - INTERVAL 3 HOUR) / 6) * 6 + 3 AS BIGINT)),
                '%Y-%m-%d %H:%M:%S') AS current_window,
       strftime(date_trunc('day', measurement_time - INTERVAL 3 HOUR)
                + to_hours(CAST(floor(hour(measurement_time - INTERVAL 3 HOUR) / 6) * 6 + 9 AS BIGINT)),
                '%Y-%m-%d %H:%M:%S') AS next_window
FROM v_rain""", "v_rain")
oracle("forecast_pick", f"""
SELECT location_id, current_rain, next_rain FROM pk""", "pk")
oracle("forecast_match", f"""
SELECT settlement_id, score, distance_km, ims_id, current_rain, next_rain FROM fm""", "fm")
oracle("settlements_updated", f"""
SELECT s.settlement_id, s.name_eng, b.current_rain AS current_6h_forecast,
       b.next_rain AS next_6h_forecast
FROM v_settlements s
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY settlement_id
                                    ORDER BY score DESC, distance_km, ims_id) AS rn FROM fm) WHERE rn = 1) b
  ON b.settlement_id = s.settlement_id""", "fm", "v_settlements")

# ---------------------------------------------------------- live ingest
ORACLES["rain_channel"] = """
SELECT CAST(s_suppkey AS INTEGER) AS station_id, s_name AS station_name, s_nationkey AS region_id,
       CAST(CASE s_suppkey % 5 WHEN 1 THEN 7 WHEN 4 THEN s_nationkey + 1 END AS INTEGER) AS channel_id
FROM supplier WHERE s_suppkey % 5 IN (1, 4)"""

oracle("latest_measurement", f"""
SELECT station_id, arg_max(event_id, (measurement_time, event_id)) AS event_id,
       max(measurement_time) AS measurement_time,
       {r6('arg_max(rain_amount_mm, (measurement_time, event_id))', 'rain_amount_mm')},
       arg_max(status, (measurement_time, event_id)) AS status
FROM v_rain WHERE event_id % 50 <> 0 AND event_id % 71 <> 0 GROUP BY station_id""", "v_rain")

oracle("monthly_flatten", f"""
SELECT station_id, measurement_time, {r6('rain_amount_mm', 'rain_amount_mm')}, status
FROM v_rain WHERE rain_amount_mm >= 0 AND status = 1""", "v_rain")

oracle("last_hour_rain", f"""
SELECT station_id, day, {r6('coalesce(sum(CASE WHEN status = 1 THEN rain_amount_mm END), 0)', 'last_hour_rain')},
       count(*) AS n_taken
FROM (SELECT *, date_trunc('day', measurement_time) AS day,
             row_number() OVER (PARTITION BY station_id, date_trunc('day', measurement_time)
                                ORDER BY measurement_time DESC, event_id DESC) AS rn FROM v_rain)
WHERE rn <= 6 GROUP BY station_id, day""", "v_rain")

oracle("registered_only", f"""
SELECT event_id, station_id, basin_id, measurement_time, {r6('rain_amount_mm', 'rain_amount_mm')}, status
FROM v_rain r WHERE EXISTS (SELECT 1 FROM v_stations s WHERE s.station_id = r.station_id)""", "v_rain", "v_stations")

oracle("unregistered", """
SELECT r.station_id, printf('%d (%s)', r.station_id, 'station-' || r.station_id) AS entry
FROM v_rain r WHERE NOT EXISTS (SELECT 1 FROM v_stations s WHERE s.station_id = r.station_id)""",
       "v_rain", "v_stations")

oracle("insert_new_rows", f"""
SELECT event_id, station_id, measurement_time, {r6('rain_amount_mm', 'rain_amount_mm')}, status
FROM (SELECT *, row_number() OVER (PARTITION BY station_id, measurement_time ORDER BY event_id) AS rn
      FROM v_rain r WHERE EXISTS (SELECT 1 FROM v_stations s WHERE s.station_id = r.station_id)) b
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM v_rain t WHERE day(t.measurement_time) <= 15
                               AND t.station_id = b.station_id AND t.measurement_time = b.measurement_time)""",
       "v_rain", "v_stations")

FRAG.update({
    "un": """SELECT * FROM rain_q WHERE day(measurement_time) <= 20
             UNION ALL SELECT * FROM rain_q WHERE day(measurement_time) >= 10""",
    "un_agg": """SELECT basin_id, station_id, date_trunc('hour', measurement_time) AS hour,
                        sum(rain_amount_mm) AS s, max(rain_amount_mm) AS mx FROM un GROUP BY ALL""",
})
FRAG_DEPS.update({"un": ("rain_q",), "un_agg": ("un",)})
oracle("rain_union", f"""
SELECT g.basin_id, g.station_id, g.hour, {r6('coalesce(a.s, 0)', 'hourly_rain_sum')},
       {r6('coalesce(a.mx, 0)', 'max_10min_intensity')}
FROM (SELECT basin_id, station_id, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour
      FROM un_agg GROUP BY basin_id, station_id) g
LEFT JOIN un_agg a ON a.basin_id = g.basin_id AND a.station_id = g.station_id AND a.hour = g.hour""", "un_agg")

# ------------------------------------------------------------ flow feed


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _feed_dims() -> tuple[str, str]:
    from ..sources.dims import FEED_STATION_SUB_BASIN, MODEL_BASIN_ROUTING
    idx = ", ".join(f"({i}, {_q(n)})" for i, (n, _) in enumerate(FEED_STATION_SUB_BASIN))
    sub = ", ".join(f"({_q(n)}, {_q(b)})" for n, b in dict(FEED_STATION_SUB_BASIN).items())
    route = ", ".join(f"({_q(s)}, {_q(m)})" for m, subs in MODEL_BASIN_ROUTING.items() for s in subs)
    return (f"SELECT * FROM (VALUES {idx}) AS t(idx, raw_name)",
            f"SELECT * FROM (VALUES {sub}) AS t(raw_name, sub_basin)") + (
        f"SELECT * FROM (VALUES {route}) AS t(sub_basin, model_basin)",)


_IDX, _SUB, _ROUTE = _feed_dims()
FRAG.update({
    "fidx": _IDX, "fsub": _SUB, "froute": _ROUTE,
    "fobs": """SELECT l_orderkey AS feed_id, l_linenumber, l_partkey, l_suppkey,
                      CASE WHEN l_linenumber = 1 AND l_orderkey % 3 = 0 THEN ''
                           WHEN l_linenumber = 2 AND l_orderkey % 5 = 0 THEN NULL
                           ELSE printf('%.1f', l_quantity) END AS flow,
                      strftime(l_shipdate, '%d/%m/%Y') AS date, printf('%02d:00', l_linenumber) AS time
               FROM lineitem""",
    "fst": """SELECT o.feed_id, count(*) AS n_obs,
                     CASE WHEN o.feed_id % 9 = 0 THEN 'station-' || o.feed_id ELSE any_value(i.raw_name) END AS raw_name
              FROM fobs o LEFT JOIN fidx i ON i.idx = o.feed_id % 65 GROUP BY o.feed_id""",
    "ffirst": """SELECT s.feed_id, s.raw_name, TRY_CAST(f.flow AS DOUBLE) AS flow_m3s,
                        f.date || ' ' || f.time AS last_updated
                 FROM fst s JOIN (SELECT *, row_number() OVER (PARTITION BY feed_id
                                                              ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn
                                  FROM fobs WHERE flow IS NOT NULL AND flow <> '') f
                   ON f.feed_id = s.feed_id AND f.rn = 1""",
    "fpeak": """SELECT sub_basin, flow_m3s, last_updated, raw_name
                FROM (SELECT f.*, n.sub_basin, row_number() OVER (PARTITION BY n.sub_basin
                                                ORDER BY f.flow_m3s DESC, f.feed_id) AS rn
                      FROM ffirst f JOIN fsub n ON n.raw_name = f.raw_name) WHERE rn = 1""",
})
FRAG_DEPS.update({"fst": ("fobs", "fidx"), "ffirst": ("fst",), "fpeak": ("ffirst", "fsub")})

oracle("flow_feed", """
SELECT feed_id, CASE WHEN feed_id % 9 = 0 OR feed_id % 4 <> 0 THEN raw_name
                    ELSE array_to_string(list_transform(string_split(raw_name, ''),
                           lambda c: CASE WHEN unicode(c) > 127 THEN '\\u' || lpad(lower(hex(unicode(c))), 4, '0')
                                          ELSE c END), '') END AS name, n_obs
FROM fst""", "fst")
oracle("unescape_names", "SELECT feed_id, raw_name FROM fst", "fst")
oracle("first_valid_obs", f"SELECT feed_id, raw_name, {r6('flow_m3s', 'flow_m3s')}, last_updated FROM ffirst",
       "ffirst")
oracle("basin_peak_flow", f"SELECT sub_basin, {r6('flow_m3s', 'flow_m3s')}, last_updated, raw_name FROM fpeak",
       "fpeak")
oracle("route_basin", f"""
SELECT p.sub_basin, {r6('p.flow_m3s', 'flow_m3s')}, p.last_updated, p.raw_name, r.model_basin
FROM fpeak p LEFT JOIN froute r ON r.sub_basin = p.sub_basin""", "fpeak", "froute")


def _thresholds(version: str) -> str:
    from ..sources.dims import BASIN_THRESHOLDS
    vals = ", ".join(f"({_q(b)}, CAST({t} AS DOUBLE))" for b, t in BASIN_THRESHOLDS[version].items())
    return f"SELECT * FROM (VALUES {vals}) AS t(basin, threshold)"


FRAG["fthr3"] = _thresholds("v3")
oracle("basin_threshold", f"""
SELECT p.sub_basin, r.model_basin AS basin, {r6('coalesce(t.threshold, 5.0)', 'threshold')}
FROM fpeak p JOIN froute r ON r.sub_basin = p.sub_basin LEFT JOIN fthr3 t
  ON t.basin = upper(substr(split_part(r.model_basin, ' ', 1), 1, 1)) || lower(substr(split_part(r.model_basin, ' ', 1), 2))""",
       "fpeak", "froute", "fthr3")

# ------------------------------------------------- warnings and digests
_COLOR = ("CASE o_orderpriority WHEN '1-URGENT' THEN 'Red' WHEN '2-HIGH' THEN 'Orange' "
          "WHEN '3-MEDIUM' THEN 'Yellow' ELSE 'Green' END")
FRAG["wn"] = f"""SELECT o_orderkey AS item_id,
       CASE WHEN o_orderkey % 11 = 0 THEN 'No Title' ELSE {_COLOR} || ' warning - flash floods' END AS title,
       CASE WHEN o_orderkey % 13 = 0 THEN 'No Description'
            ELSE 'Regions: Region ' || CAST(o_custkey % 25 AS VARCHAR) || '. Timeframe: '
                 || printf('%02d', o_orderkey % 20) || ':00 to 22:00 LT' END AS details,
       CASE WHEN o_orderkey % 11 = 0 THEN 'No' ELSE {_COLOR} END AS color,
       CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'Flash Floods' END AS wtype,
       CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'Region ' || CAST(o_custkey % 25 AS VARCHAR) END AS regions,
       CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE printf('%02d', o_orderkey % 20) || ':00 to 22:00 LT' END AS tf
FROM orders"""
oracle("warnings_clean", "SELECT item_id, title, details FROM wn", "wn")
oracle("warnings_digest", """
SELECT NULL::DOUBLE AS sort_key, CASE WHEN count(*) > 0 THEN '# 30/01/2024'
       ELSE 'No active warnings currently in the IMS feed.' END AS block FROM wn
UNION ALL
SELECT CAST(item_id AS DOUBLE), '## ' || color || ' - ' || wtype || chr(10) || 'Regions: ' || regions || chr(10)
       || 'Timeframe: ' || tf FROM wn""", "wn")
oracle("warnings_list", """
SELECT NULL::DOUBLE AS sort_key, CASE WHEN count(*) > 0 THEN 'Active IMS Warnings found:'
       ELSE 'No active warnings currently in the IMS feed.' END AS block FROM wn
UNION ALL
SELECT CAST(item_id AS DOUBLE), '- Title: ' || title || chr(10) || '  Details: ' || details || chr(10) FROM wn""", "wn")
oracle("alert_digest", f"""
, hr5 AS (SELECT coalesce(s.station_name, 'station-' || r.station_id) AS station_name, r.measurement_time,
                 r.rain_amount_mm FROM v_rain r LEFT JOIN v_stations s ON s.station_id = r.station_id
          WHERE r.rain_amount_mm >= 5.0)
SELECT NULL::DOUBLE AS sort_key, CASE WHEN count(*) > 0 THEN printf('Found %d records exceeding 5.0mm:', count(*))
       ELSE 'No stations recorded rainfall above 5.0mm.' END AS line FROM hr5
UNION ALL
SELECT {r6('rain_amount_mm', 'sort_key')}, printf('- Station ''%s'' at %s: %smm', station_name,
       strftime(measurement_time, '%Y-%m-%d %H:%M:%S'), CAST(rain_amount_mm AS VARCHAR)) FROM hr5""".lstrip(),
       "v_rain", "v_stations")

# ------------------------------------------------------- forecast XML
oracle("forecast_flatten", f"""
SELECT location_id, forecast_time, coalesce(rain, 0) AS rain,
       CAST(row_number() OVER (PARTITION BY location_id, date_trunc('day', forecast_time)
                               ORDER BY forecast_time, pos) - 1 AS DOUBLE) AS pos
FROM v_forecast WHERE location_id % 17 <> 0
UNION ALL
SELECT location_id, NULL::TIMESTAMP, 0.0, NULL::DOUBLE
FROM (SELECT DISTINCT location_id, date_trunc('day', forecast_time) AS d FROM v_forecast WHERE location_id % 17 = 0)""",
       "v_forecast")
oracle("location_coords", f"""
SELECT ims_id, ims_name,
       {r6("CASE WHEN lat IS NOT NULL AND ims_id % 13 = 0 THEN NULL ELSE lat END", 'lat')},
       {r6("CASE WHEN lat IS NOT NULL AND ims_id % 13 = 0 THEN NULL ELSE lon END", 'lon')}
FROM v_locations""", "v_locations")

# ------------------------------------------------------------ raw CSV
oracle("rain_clean", f"""
SELECT event_id, 'station-' || station_id AS station, date_trunc('minute', measurement_time) AS measurement_time,
       {r6('CASE WHEN event_id % 23 = 0 THEN 0.0 ELSE rain_amount_mm END', 'rainfall')}
FROM v_rain WHERE event_id % 29 <> 0""", "v_rain")
oracle("flow_clean", f"""
SELECT basin_id, date_trunc('second', measurement_time) AS measurement_time,
       {r6('CASE WHEN minute(measurement_time) = 7 THEN NULL ELSE flow END', 'flow')}
FROM v_flow WHERE second(measurement_time) <> 13""", "v_flow")
ORACLES["name_from_file"] = """
SELECT s_suppkey,
       array_to_string(list_transform(list_slice(string_split(lower(replace(s_name, '#', '_')) || '_2010_2018', '_'),
                                                 1, len(string_split(lower(replace(s_name, '#', '_')), '_'))),
         lambda w: upper(w[1]) || lower(w[2:])), ' ') AS station_name,
       upper((string_split(s_name, '#'))[1][1]) || lower((string_split(s_name, '#'))[1][2:]) AS basin_name
FROM supplier"""

# ------------------------------------------------------------ streaming
# The feed lands in four parts (days 1-8, 9-16, 17-24, 25-31) with a poll after
# each; readings of days 1-8 at minute 7 come with the last part, behind the
# watermark (newest time of the parts before, less one hour), and are dropped.
_ON_TIME = "NOT (day(measurement_time) <= 8 AND minute(measurement_time) = 7)"

oracle("stream_rolling_rain", f"""
SELECT station_id, ws AS window_start, ws + INTERVAL 1 HOUR AS window_end,
       {r6('sum(CASE WHEN status = 1 THEN rain_amount_mm END)', 'rain_1h')}, count(*) AS n_readings
FROM (SELECT r.*, b.ws FROM v_rain r,
        LATERAL (SELECT date_trunc('hour', r.measurement_time)
                        + to_minutes(CAST(floor(minute(r.measurement_time) / 10) * 10 AS BIGINT))
                        - to_minutes(CAST(10 * k AS BIGINT)) AS ws
                 FROM range(0, 6) AS t(k)) b WHERE {_ON_TIME})
GROUP BY station_id, ws""", "v_rain")
oracle("stream_alerts", f"""
SELECT event_id, station_id, measurement_time, {r6('rain_amount_mm', 'rain_amount_mm')}, status
FROM v_rain WHERE rain_amount_mm >= 5.0""", "v_rain")
oracle("stream_insert_once", "SELECT DISTINCT station_id, measurement_time FROM v_rain", "v_rain")
oracle("stream_dedup", f"SELECT DISTINCT station_id, measurement_time FROM v_rain WHERE {_ON_TIME}", "v_rain")
oracle("stream_sessions", f"""
SELECT basin_id, min(t) AS session_start, max(t) + INTERVAL 1 HOUR AS session_end, count(*) AS n_readings,
       {r6('max(flow)', 'peak_flow')}, max(t) + INTERVAL 1 HOUR > newest - INTERVAL 1 HOUR AS is_open
FROM (SELECT *, sum(begins) OVER (PARTITION BY basin_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS sid
      FROM (SELECT basin_id, measurement_time AS t, flow, max(measurement_time) OVER () AS newest,
                   CASE WHEN measurement_time <= lag(measurement_time) OVER (PARTITION BY basin_id ORDER BY measurement_time)
                             + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS begins
            FROM v_flow WHERE flow > 25.0 AND {_ON_TIME}))
GROUP BY basin_id, sid, newest""", "v_flow")

# --------------------------------------------------------------- models
_al_cols = ", ".join("0.0 AS Soil_Moisture_EWM" if c == "Soil_Moisture_EWM"
                     else (f"CAST({c} AS DOUBLE) AS {c}" if c in _INT_FEATURES else r6(c, c))
                     for c in FEATURE_NAMES)
ORACLES["align_features"] = _features_clean(f"SELECT basin_id, hour, {_al_cols} FROM fc")

# the training rows of each basin, every split of the first node over quantile edges, and the best of them
_ew_values = ", ".join(f"CAST({c if c in _INT_FEATURES else f'round({c}, 6) + 0.0'} AS DOUBLE)" for c in FEATURE_NAMES)
_ew_names = ", ".join(f"'{c}'" for c in FEATURE_NAMES)
ORACLES["early_warning"] = _features_clean(f"""
, base AS (SELECT basin_id, hour, round(flow2, 6) AS flow, [{_ew_values}] AS x FROM fc)
, lab AS (SELECT *, coalesce(CAST(lead(flow) {_W} > 25.0 AS INTEGER), 0) AS y, hour <= TIMESTAMP '2024-01-20 00:00:00' AS train FROM base)
, facts AS (SELECT basin_id, count(*) FILTER (WHERE train) AS n_train, count(*) FILTER (WHERE NOT train) AS n_test,
    CAST(coalesce(sum(y) FILTER (WHERE train), 0) AS BIGINT) AS train_floods FROM lab GROUP BY basin_id)
, wt AS (SELECT *, (n_train - train_floods) / CAST(greatest(train_floods, 1) AS DOUBLE) AS spw FROM facts)
, long AS (SELECT basin_id, unnest(range(0, 38)) AS feature, unnest(x) AS v, CASE WHEN y = 1 THEN spw ELSE 1.0 END AS w, y
           FROM lab JOIN wt USING (basin_id) WHERE train)
, ranked AS (SELECT basin_id, feature, v, row_number() OVER (PARTITION BY basin_id, feature ORDER BY v) - 1 AS r,
             count(*) OVER (PARTITION BY basin_id, feature) AS n FROM long)
, edges AS (SELECT DISTINCT basin_id, feature, v AS e FROM ranked, (SELECT unnest(range(1, 32)) AS k) WHERE r = (k * (n - 1)) // 32)
, sides AS (SELECT basin_id, feature, e, sum(w * (0.5 - y)) FILTER (WHERE v <= e) AS gl, sum(w * 0.25) FILTER (WHERE v <= e) AS hl,
            sum(w * (0.5 - y)) AS g, sum(w * 0.25) AS h, count(*) FILTER (WHERE v > e) AS nr
            FROM long JOIN edges USING (basin_id, feature) GROUP BY basin_id, feature, e)
, gains AS (SELECT *, gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1) AS gain
            FROM sides WHERE nr > 0 AND hl >= 1 AND h - hl >= 1)
, best AS (SELECT * FROM gains WHERE gain > 1e-9
           QUALIFY row_number() OVER (PARTITION BY basin_id ORDER BY round(gain, 9) DESC, feature, e) = 1)
SELECT wt.basin_id, n_train, n_test, train_floods, {r6('spw', 'scale_pos_weight')}, [{_ew_names}][feature + 1] AS root_feature,
       {r6('e', 'root_threshold')}, {r6('gain', 'root_gain')}, {r6('-0.05 * gl / (hl + 1)', 'left_value')},
       {r6('-0.05 * (g - gl) / (h - hl + 1)', 'right_value')}, CASE WHEN n_train > 0 AND n_test > 0 THEN n_test END AS n_scored
FROM wt LEFT JOIN best USING (basin_id)""")

ORACLES["features_clean_chunked"] = ORACLES["features_clean"]

# features built hour by hour from kept state are those of the whole history
ORACLES["live_features"] = ORACLES["features_clean"]
