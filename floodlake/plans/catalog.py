"""Registered queries: each reads the driver's tables through the adapter
views and runs one operator (or a short composition) of the library.

Doubles are rounded to 6 decimals at the output only, so the result can
be compared value by value with the DuckDB oracle in ``oracles.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..fixtures import base as base_table
from ..fixtures import view
from ..functions.geo import haversine_km
from ..functions.text import basin_from_file, name_score, station_from_file, unescape_unicode
from ..functions.timecols import as_text, forecast_windows
from ..operators import alerts, boost, events, forecast, grid, live, match, metrics, ml, quality, spatial, stats
from ..operators import features as feat
from ..operators import longseries
from ..session import cut_lineage
from ..sources import dims, feeds, files
from ..streaming import live_features, streams
from . import hydrology, models

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[
        F.round(F.col(f.name), digits).alias(f.name)
        if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
        for f in df.schema.fields])


# ---------------------------------------------------------------- inputs

def clean_rain(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_filter(view(spark, d, "v_rain"))


def station_hours(spark: SparkSession, d: str) -> DataFrame:
    return hydrology.station_hours(view(spark, d, "v_rain"))


def basin_flow(spark: SparkSession, d: str) -> DataFrame:
    return grid.hourly_flow(view(spark, d, "v_flow"))


def merged(spark: SparkSession, d: str) -> DataFrame:
    return hydrology.basin_hours(view(spark, d, "v_rain"), view(spark, d, "v_flow"))


# --------------------------------------------------------- filters / grid

@register("quality_filter")
def q_quality_filter(spark, d):
    return rounded(clean_rain(spark, d))


@register("high_rainfall")
def q_high_rainfall(spark, d):
    rain = view(spark, d, "v_rain")
    named = rain.join(view(spark, d, "v_stations"), "station_id", "left").withColumn(
        "station_name", F.coalesce("station_name", F.format_string("station-%d", F.col("station_id"))))
    return rounded(quality.high_rainfall(named, 5.0))


@register("hourly_rain")
def q_hourly_rain(spark, d):
    # a single consumer: nothing to gain from materializing the grid here
    return rounded(hydrology.station_hours(view(spark, d, "v_rain"), materialize=False))


@register("hourly_flow")
def q_hourly_flow(spark, d):
    return rounded(basin_flow(spark, d))


@register("hour_grid")
def q_hour_grid(spark, d):
    return grid.hour_coverage(view(spark, d, "v_flow"))


@register("station_align")
def q_station_align(spark, d):
    return rounded(spatial.station_align(station_hours(spark, d)))


@register("basin_stats")
def q_basin_stats(spark, d):
    return rounded(spatial.basin_stats(station_hours(spark, d)))


@register("features_base")
def q_features_base(spark, d):
    return rounded(merged(spark, d))


# ------------------------------------------------------------- features

@register("lag_features")
def q_lag_features(spark, d):
    df = feat.flow_features(merged(spark, d))
    keep = ["basin_id", "hour", "flow"] + feat.FLOW_FEATURES
    return rounded(df.select(*keep))


@register("diff_features")
def q_diff_features(spark, d):
    m = merged(spark, d)
    return rounded(m.select("basin_id", "hour",
                            feat.diff("flow").alias("Flow_Rate_of_Change"),
                            feat.diff("Basin_Rain_Mean").alias("Rain_Acceleration")))


@register("rolling_rain")
def q_rolling_rain(spark, d):
    m = merged(spark, d)
    return rounded(m.select("basin_id", "hour", *[
        feat.rolling_sum("Basin_Rain_Mean", n, 1).alias(f"Rolling_Rain_{n}h") for n in feat.ROLLING_HOURS]))


@register("soil_moisture")
def q_soil_moisture(spark, d):
    m = merged(spark, d)
    return rounded(feat.ewm(m, "Basin_Rain_Mean", "Soil_Moisture_EWM")
                   .select("basin_id", "hour", "Soil_Moisture_EWM"))


@register("seasonality")
def q_seasonality(spark, d):
    return rounded(basin_flow(spark, d).select("basin_id", "hour", *feat.seasonality("hour")))


@register("suspicious_hours")
def q_suspicious_hours(spark, d):
    m = merged(spark, d)
    return rounded(m.withColumn("_s", feat.suspicious_hours("flow")).filter("_s")
                   .select("basin_id", "hour", "flow"))


@register("features_clean")
def q_features_clean(spark, d):
    return rounded(feat.clean_features(merged(spark, d)))


@register("dataset_profile")
def q_dataset_profile(spark, d):
    return rounded(stats.dataset_profile(feat.clean_features(merged(spark, d)), feat.FEATURE_NAMES))


@register("clean_audit")
def q_clean_audit(spark, d):
    m = merged(spark, d)
    return feat.clean_audit(m, feat.clean_features(m))


# ------------------------------------------------------ events and stats
# Fixed parameters of the registered checks: flood level on the fixture
# flows, split time inside the fixture month, decision thresholds.
FIXTURE_FLOOD_LEVEL = 25.0
FIXTURE_SPLIT_AT = "2024-01-20 00:00:00"


def scored(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_scored")


@register("flow_distribution")
def q_flow_distribution(spark, d):
    return rounded(stats.flow_distribution(basin_flow(spark, d)))


@register("threshold_sweep")
def q_threshold_sweep(spark, d):
    return events.threshold_sweep(basin_flow(spark, d))


def sessions(spark, d):
    return events.flood_sessions(basin_flow(spark, d), FIXTURE_FLOOD_LEVEL)


@register("flood_sessions")
def q_flood_sessions(spark, d):
    return rounded(sessions(spark, d))


@register("flood_events")
def q_flood_events(spark, d):
    return rounded(events.flood_events(sessions(spark, d)))


@register("event_cutoff")
def q_event_cutoff(spark, d):
    out = events.event_cutoff(events.flood_events(sessions(spark, d)))
    return out.withColumn("cutoff_event", F.col("cutoff_event").cast("double"))


@register("peak_hydrograph")
def q_peak_hydrograph(spark, d):
    return rounded(events.peak_hydrograph(basin_flow(spark, d)))


@register("row_split")
def q_row_split(spark, d):
    return events.row_split(basin_flow(spark, d)).select("basin_id", "hour", "split")


@register("flow_duration")
def q_flow_duration(spark, d):
    return rounded(stats.flow_duration(basin_flow(spark, d)))


@register("grid_profile")
def q_grid_profile(spark, d):
    return rounded(stats.grid_profile(basin_flow(spark, d)))


@register("time_split")
def q_time_split(spark, d):
    return events.time_split(basin_flow(spark, d), FIXTURE_SPLIT_AT).select("basin_id", "hour", "split")


@register("label_now")
def q_label_now(spark, d):
    return rounded(events.label_now(basin_flow(spark, d), FIXTURE_FLOOD_LEVEL))


@register("label_ahead")
def q_label_ahead(spark, d):
    return rounded(events.label_ahead(basin_flow(spark, d), FIXTURE_FLOOD_LEVEL, 1))


@register("class_balance")
def q_class_balance(spark, d):
    lab = events.label_ahead(basin_flow(spark, d), FIXTURE_FLOOD_LEVEL, 1)
    train = events.time_split(lab, FIXTURE_SPLIT_AT).filter(F.col("split") == "train")
    return rounded(metrics.class_balance(train, "flood_in_1h"))


# ----------------------------------------------------------- metrics

@register("flood_decision")
def q_flood_decision(spark, d):
    s = scored(spark, d)
    return rounded(s.select("event_id", "basin_id", "proba",
                            events.decide("proba", 0.5, True).alias("decision_v1"),
                            events.decide("proba", 0.3, False).alias("decision_v3"),
                            events.decide("proba", 0.03, True).alias("alert")))


@register("class_weights")
def q_class_weights(spark, d):
    return rounded(metrics.class_weights(scored(spark, d)))


def predicted_labels(spark, d):
    return scored(spark, d).withColumn("pred", events.decide("proba", 0.3, False))


@register("confusion")
def q_confusion(spark, d):
    return metrics.confusion(predicted_labels(spark, d))


@register("class_report")
def q_class_report(spark, d):
    return rounded(metrics.class_report(predicted_labels(spark, d)))


@register("roc_auc")
def q_roc_auc(spark, d):
    return rounded(metrics.roc_auc(scored(spark, d)))


@register("regression_metrics")
def q_regression_metrics(spark, d):
    return rounded(metrics.regression_metrics(scored(spark, d)))


@register("flood_metrics")
def q_flood_metrics(spark, d):
    return rounded(metrics.flood_metrics(scored(spark, d), FIXTURE_FLOOD_LEVEL))


@register("event_peaks")
def q_event_peaks(spark, d):
    s = scored(spark, d)
    floods = events.flood_sessions(s.select("basin_id", "ts", "actual"), FIXTURE_FLOOD_LEVEL,
                                   flow="actual", order="ts")
    ev = events.flood_events(floods, flow="actual", order="ts")
    return rounded(events.event_peaks(s, ev))


# ------------------------------------------------- matching and forecast

def twins(spark, d):
    """Each location next to the settlement it was derived from."""
    loc = view(spark, d, "v_locations")
    st = view(spark, d, "v_settlements").select(
        F.col("settlement_id"), F.col("name_eng"), F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    return loc.join(st, loc["ims_id"] == st["settlement_id"])


@register("haversine")
def q_haversine(spark, d):
    t = twins(spark, d)
    return rounded(t.select("ims_id", "settlement_id", F.round(
        haversine_km(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon")), 2).alias("distance_km")))


@register("name_score")
def q_name_score(spark, d):
    t = twins(spark, d)
    return t.select("ims_id", "ims_name", "name_eng", name_score(F.col("ims_name"), F.col("name_eng")).alias("score"))


def geo_matches(spark, d):
    return match.geo_match(view(spark, d, "v_locations"), view(spark, d, "v_settlements"))


@register("geo_match")
def q_geo_match(spark, d):
    return rounded(geo_matches(spark, d))


@register("mapping_clean")
def q_mapping_clean(spark, d):
    return rounded(forecast.mapping_clean(geo_matches(spark, d)).drop("ims_key"))


@register("forecast_windows")
def q_forecast_windows(spark, d):
    ev = view(spark, d, "v_rain")
    cur, nxt = forecast_windows(F.col("measurement_time"))
    return ev.select("event_id", "measurement_time", as_text(cur).alias("current_window"),
                     as_text(nxt).alias("next_window"))


def picked(spark, d):
    fc = view(spark, d, "v_forecast")
    # per location, as of 5 hours before its last forecast time
    as_of = fc.groupBy("location_id").agg(
        (F.max("forecast_time") - F.expr("INTERVAL 5 HOURS")).alias("as_of"))
    # one row per location: broadcast, so the forecast rows are not shuffled by location
    return forecast.forecast_pick(fc.join(F.broadcast(as_of), "location_id"), F.col("as_of"))


@register("forecast_pick")
def q_forecast_pick(spark, d):
    return picked(spark, d)  # picked values pass through unrounded


@register("forecast_match")
def q_forecast_match(spark, d):
    return forecast.forecast_match(geo_matches(spark, d), picked(spark, d))


@register("settlements_updated")
def q_settlements_updated(spark, d):
    matched = forecast.forecast_match(geo_matches(spark, d), picked(spark, d))
    st = view(spark, d, "v_settlements").select("settlement_id", "name_eng")
    return forecast.update_forecasts(st, matched)


# ---------------------------------------------------------- live ingest
# Raw feed text is built from the adapter views (JSON / XML the station
# API would have returned) and parsed back by the source operators.

STATION_JSON = """to_json(named_struct('stationId', CAST(s_suppkey AS INT), 'name', s_name, 'regionId', s_nationkey,
  'monitors', CASE s_suppkey % 5
     WHEN 0 THEN NULL
     WHEN 1 THEN array(named_struct('channelId', 1, 'name', 'TD'), named_struct('channelId', 7, 'name', 'Rain'),
                       named_struct('channelId', 8, 'name', 'Rain'))
     WHEN 2 THEN array(named_struct('channelId', 0, 'name', 'Rain'))
     WHEN 3 THEN array(named_struct('channelId', 3, 'name', 'WS'))
     ELSE array(named_struct('channelId', s_nationkey + 1, 'name', 'Rain')) END))"""
READING = ("named_struct('datetime', date_format(measurement_time, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"), "
           "'channels', array(named_struct('value', rain_amount_mm, 'status', status)))")
LATEST_JSON = f"""CASE WHEN event_id % 50 = 0 THEN '{{"data": []}}'
     WHEN event_id % 71 = 0 THEN '{{"data": [ broken'
     ELSE to_json(named_struct('data', array({READING}))) END"""


@register("rain_channel")
def q_rain_channel(spark, d):
    from ..fixtures import base
    raw = base(spark, d, "supplier").select(F.expr(STATION_JSON).alias("json"))
    return feeds.rain_channel(raw.select(feeds.parse_stations(F.col("json")).alias("s")).select("s.*"))


@register("latest_measurement")
def q_latest_measurement(spark, d):
    raw = view(spark, d, "v_rain").select("event_id", "station_id", F.expr(LATEST_JSON).alias("json"))
    rec = raw.select("event_id", "station_id", feeds.latest_reading(feeds.parse_envelope(F.col("json"))).alias("r"))
    rec = rec.filter(F.col("r").isNotNull()).select("event_id", "station_id", "r.*")
    return rounded(live.latest_per_key(rec, ["station_id"], ["measurement_time", "event_id"]))


@register("monthly_flatten")
def q_monthly_flatten(spark, d):
    v = view(spark, d, "v_rain")
    env = (v.groupBy("station_id", F.date_trunc("hour", "measurement_time").alias("h"))
           .agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.expr(READING))).alias("data"))).alias("json")))
    rows = feeds.flatten_readings(env.select("station_id", feeds.parse_envelope(F.col("json")).alias("env")))
    return rounded(quality.quality_filter(rows).select("station_id", "measurement_time", "rain_amount_mm", "status"))


@register("last_hour_rain")
def q_last_hour_rain(spark, d):
    rain = view(spark, d, "v_rain")
    v = rain.withColumn("day", grid.truncate(rain, "measurement_time", "day"))
    return rounded(live.last_hour_rain(v, ["station_id", "day"], ["measurement_time", "event_id"]))


def named_rain(spark, d):
    rain = view(spark, d, "v_rain")
    st = view(spark, d, "v_stations").select("station_id", "station_name")
    return rain.join(st, "station_id", "left").withColumn(
        "station_name", F.coalesce("station_name", F.format_string("station-%d", F.col("station_id"))))


@register("registered_only")
def q_registered_only(spark, d):
    return rounded(quality.registered(view(spark, d, "v_rain"), view(spark, d, "v_stations")))


@register("unregistered")
def q_unregistered(spark, d):
    return quality.unregistered(named_rain(spark, d), view(spark, d, "v_stations")).select(
        "station_id", "entry")


@register("insert_new_rows")
def q_insert_new_rows(spark, d):
    rain = view(spark, d, "v_rain")
    day = grid.truncate(rain, "measurement_time", "day")
    batch = named_rain(spark, d).withColumn("day", day)
    target = rain.filter(F.dayofmonth("measurement_time") <= 15).withColumn("day", day)
    new = live.upsert_new(batch, target, view(spark, d, "v_stations"),
                          ["station_id", "measurement_time", "day"], prune_by="day")
    return rounded(new.select("event_id", "station_id", "measurement_time", "rain_amount_mm", "status"))


@register("rain_union")
def q_rain_union(spark, d):
    v = quality.quality_filter(view(spark, d, "v_rain"))
    files = [v.filter(F.dayofmonth("measurement_time") <= 20), v.filter(F.dayofmonth("measurement_time") >= 10)]
    return rounded(grid.hourly_rain(quality.union_files(files)))


# ------------------------------------------------------------ flow feed
N_FEED_NAMES = len(dims.FEED_STATION_SUB_BASIN)


def feed(spark, d):
    """Live flow feed text: one station per order, one observation per line
    (some flows empty or missing); names from the published list, every
    4th escaped as \\uXXXX, every 9th order an unknown station."""
    li = base_table(spark, d, "lineitem")
    obs = F.struct(
        F.expr("CASE WHEN l_linenumber = 1 AND l_orderkey % 3 = 0 THEN '' "
               "WHEN l_linenumber = 2 AND l_orderkey % 5 = 0 THEN NULL "
               "ELSE format_string('%.1f', l_quantity) END").alias("flow"),
        F.date_format("l_shipdate", "dd/MM/yyyy").alias("date"),
        F.format_string("%02d:00", F.col("l_linenumber")).alias("time"))
    st = li.groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"),
                                                         F.col("l_suppkey").alias("s"), obs.alias("o")))),
                    lambda e: e["o"]).alias("obs"))
    names = F.broadcast(dims.feed_name_index(spark))  # fixed size
    st = st.join(names, (F.col("l_orderkey") % N_FEED_NAMES).cast("int") == names["idx"], "left")
    name = (F.when(F.col("l_orderkey") % 9 == 0, F.format_string("station-%d", F.col("l_orderkey")))
            .when(F.col("l_orderkey") % 4 == 0, F.col("escaped_name")).otherwise(F.col("raw_name")))
    text = F.to_json(F.struct(name.alias("name"), F.col("obs")))
    return st.select(F.col("l_orderkey").alias("feed_id"), text.alias("json"))


def parsed_feed(spark, d):
    return feed(spark, d).select("feed_id", feeds.parse_flow_feed(F.col("json")).alias("s")).select("feed_id", "s.*")


@register("flow_feed")
def q_flow_feed(spark, d):
    return parsed_feed(spark, d).select("feed_id", "name", F.size("obs").cast("bigint").alias("n_obs"))


@register("unescape_names")
def q_unescape_names(spark, d):
    return parsed_feed(spark, d).select("feed_id", unescape_unicode(F.col("name")).alias("raw_name"))


def first_obs(spark, d):
    return live.first_valid_obs(parsed_feed(spark, d))


@register("first_valid_obs")
def q_first_valid_obs(spark, d):
    return rounded(first_obs(spark, d))


def peaks(spark, d):
    return live.basin_peak_flow(first_obs(spark, d), dims.feed_names(spark))


@register("basin_peak_flow")
def q_basin_peak_flow(spark, d):
    return rounded(peaks(spark, d))


@register("route_basin")
def q_route_basin(spark, d):
    routed = live.route_basin(peaks(spark, d), dims.routing(spark))
    return rounded(routed.orderBy(F.col("flow_m3s").desc(), "sub_basin"))  # live listing, highest flow first


@register("basin_threshold")
def q_basin_threshold(spark, d):
    routed = live.route_basin(peaks(spark, d), dims.routing(spark)).filter(F.col("model_basin").isNotNull())
    # thresholds are keyed by the name that a dataset's file name yields
    key = basin_from_file(F.concat(F.lit("Flood_"), F.replace(F.col("model_basin"), F.lit(" "), F.lit("_"))), 2)
    named = routed.select("sub_basin", F.col("model_basin").alias("basin"), key.alias("file_basin"))
    out = dims.basin_threshold(named, spark, "v3", basin="file_basin")
    return rounded(out.select("sub_basin", "basin", "threshold"))


# ------------------------------------------------- warnings and digests
WARNING_COLOR = ("CASE o_orderpriority WHEN '1-URGENT' THEN 'Red' WHEN '2-HIGH' THEN 'Orange' "
                 "WHEN '3-MEDIUM' THEN 'Yellow' ELSE 'Green' END")
WARNING_XML = f"""concat('<item>',
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat('<title>', {WARNING_COLOR}, ' warning - flash floods</title>') END,
  CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE concat('<description>&lt;p style=''padding-bottom:30px;''&gt;Regions: Region ',
       CAST(o_custkey % 25 AS STRING), '. Timeframe: ', format_string('%02d', CAST(o_orderkey % 20 AS INT)),
       ':00 to 22:00 LT&lt;/p&gt;</description>') END,
  '</item>')"""
DIGEST_DATE = "30/01/2024"


def warnings(spark, d):
    raw = base_table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"),
                                                F.expr(WARNING_XML).alias("xml"))
    items = raw.select("item_id", feeds.parse_warning(F.col("xml")).alias("w")).select("item_id", "w.*")
    return feeds.clean_warnings(items)


@register("warnings_clean")
def q_warnings_clean(spark, d):
    return warnings(spark, d).select("item_id", F.col("title_clean").alias("title"), "details")


def in_order(digest):
    """The order key as a double, as in the other queries with a null number."""
    return digest.withColumn("sort_key", F.col("sort_key").cast("double"))


@register("warnings_digest")
def q_warnings_digest(spark, d):
    return in_order(alerts.warnings_digest(warnings(spark, d), DIGEST_DATE))


@register("warnings_list")
def q_warnings_list(spark, d):
    return in_order(alerts.warnings_list(warnings(spark, d)))


@register("alert_digest")
def q_alert_digest(spark, d):
    rows = named_rain(spark, d).filter(F.col("rain_amount_mm") >= 5.0)
    return rounded(alerts.alert_digest(rows, 5.0))


# ------------------------------------------------------- forecast XML
FORECAST_XML = """concat('<Location><LocationMetaData><LocationId>', CAST(location_id AS STRING),
  '</LocationId><LocationNameEng>Loc ', CAST(location_id AS STRING),
  '</LocationNameEng><DisplayLat></DisplayLat><DisplayLon></DisplayLon></LocationMetaData>',
  CASE WHEN location_id % 17 = 0 THEN '' ELSE concat('<LocationData>', array_join(transform(fs, f -> concat(
    '<Forecast><ForecastTime>', date_format(f.forecast_time, 'yyyy-MM-dd HH:mm:ss'), '</ForecastTime><Rain>',
    coalesce(CAST(f.rain AS STRING), ''), '</Rain></Forecast>')), ''), '</LocationData>') END,
  '</Location>')"""


@register("forecast_flatten")
def q_forecast_flatten(spark, d):
    fc = view(spark, d, "v_forecast").withColumn("day", F.date_trunc("day", "forecast_time"))
    el = fc.groupBy("location_id", "day").agg(
        F.array_sort(F.collect_list(F.struct("forecast_time", "pos", "rain"))).alias("fs"))
    loc = el.select(feeds.parse_forecast_location(F.expr(FORECAST_XML)).alias("loc"))
    rows = feeds.forecast_rows(loc)
    # rain passes through unchanged, so it is compared unrounded
    return rows.select(F.col("location_id").cast("int").alias("location_id"), "forecast_time",
                       "rain", F.col("pos").cast("double").alias("pos"))


LOCATION_XML = """concat('<Location><LocationMetaData><LocationId>', CAST(ims_id AS STRING),
  '</LocationId><LocationNameEng>', ims_name, '</LocationNameEng><DisplayLat>',
  CASE WHEN lat IS NULL THEN '' WHEN ims_id % 13 = 0 THEN 'n/a' ELSE CAST(lat AS STRING) END,
  '</DisplayLat><DisplayLon>', CAST(lon AS STRING), '</DisplayLon></LocationMetaData></Location>')"""


@register("location_coords")
def q_location_coords(spark, d):
    loc = view(spark, d, "v_locations").select(feeds.parse_forecast_location(F.expr(LOCATION_XML)).alias("loc"))
    out = feeds.location_coords(loc)
    return rounded(out.withColumn("ims_id", F.col("ims_id").cast("bigint")))


# ------------------------------------------------------------ raw CSV
RAIN_CSV = """concat_ws(',', concat('station-', CAST(station_id AS STRING)),
  CASE WHEN event_id % 29 = 0 THEN '31/02/2024 10:00'
       WHEN event_id % 31 = 0 THEN date_format(measurement_time, 'd/M/yyyy H:mm')
       ELSE date_format(measurement_time, 'dd/MM/yyyy HH:mm') END,
  CASE WHEN event_id % 23 = 0 THEN 'abc' ELSE CAST(rain_amount_mm AS STRING) END)"""
FLOW_CSV = """concat_ws(',', '0', CAST(basin_id AS STRING), 'nahal', concat('Stream ', CAST(basin_id AS STRING)), '2024',
  CASE WHEN second(measurement_time) = 13 THEN '31/02/2024 10:00:00'
       ELSE date_format(measurement_time, 'dd/MM/yyyy HH:mm:ss') END,
  '0.5', CASE WHEN minute(measurement_time) = 7 THEN 'n/a' ELSE CAST(flow AS STRING) END, '1', '1', '0')"""


@register("rain_clean")
def q_rain_clean(spark, d):
    lines = view(spark, d, "v_rain").select("event_id", F.expr(RAIN_CSV).alias("line"))
    return rounded(files.clean_rain_lines(lines).select("event_id", "station", "measurement_time", "rainfall"))


@register("flow_clean")
def q_flow_clean(spark, d):
    lines = view(spark, d, "v_flow").select(F.expr(FLOW_CSV).alias("line"))
    out = files.clean_flow_lines(lines)
    return rounded(out.select(F.col("station_code").cast("int").alias("basin_id"), "measurement_time", "flow"))


@register("name_from_file")
def q_name_from_file(spark, d):
    s = base_table(spark, d, "supplier")
    rain_file = F.concat(F.lit("/data/ims/"), F.lower(F.replace(F.col("s_name"), F.lit("#"), F.lit("_"))),
                         F.lit("_2010_2018.csv"))
    dataset = F.concat(F.lit("organized/Flood_"), F.replace(F.col("s_name"), F.lit("#"), F.lit("_")),
                       F.lit("_ML_Dataset_v3.csv"))
    return s.select("s_suppkey", station_from_file(rain_file).alias("station_name"),
                    basin_from_file(dataset, 2).alias("basin_name"))


# ------------------------------------------------------------ streaming
# The feed rows are landed as parquet files in the shared checkpoint
# folder (what the outside collector does every hour), then processed by
# a Structured Streaming query with an availableNow trigger.

def landed_rain(spark, d) -> tuple[str, object]:
    rows = view(spark, d, "v_rain").select("event_id", "station_id", "measurement_time", "rain_amount_mm", "status")
    path = streams.scratch_path(spark, "landing", "rain")
    rows.repartitionByRange("measurement_time").write.parquet(path)
    return path, rows.schema


#: days of the month on which a landing ends, and the readings of the first
#: landing that come with the last one, when the watermark has long passed them
LANDING_ENDS = (8, 16, 24, 31)
LATE = "day(measurement_time) <= 8 AND minute(measurement_time) = 7"


def run_landings(rows: DataFrame, name: str, out: str, body: Callable[[DataFrame], DataFrame], mode: str = "append") -> None:
    """Land ``rows`` in four parts and poll after each: every poll is a run of
    the same query from its checkpoint, with a micro-batch of its own."""
    spark = rows.sparkSession
    path = streams.scratch_path(spark, "landing", name)
    late, day, start = F.expr(LATE), F.dayofmonth("measurement_time"), 0
    for end in LANDING_ENDS:
        part = (day > start) & (day <= end)
        if end == LANDING_ENDS[-1]:
            part = part | late
        else:
            part = part & ~late
        rows.where(part).write.mode("append").parquet(path)
        s = streams.event_time(streams.ingest_stream(spark, path, rows.schema), "measurement_time")
        streams.run_available(body(s), out, mode)
        start = end


@register("stream_rolling_rain")
def q_stream_rolling_rain(spark, d):
    """R3 over four polls; readings behind the watermark are dropped."""
    rows = view(spark, d, "v_rain").select("event_id", "station_id", "measurement_time", "rain_amount_mm", "status")
    out = streams.scratch_path(spark, "sinks", "rolling_rain")
    run_landings(rows, "rain", out, lambda s: streams.rolling_rain_stream(s).select(
        "station_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        "rain_1h", "n_readings"), mode="update")
    final = streams.latest_by_key(spark, out, ["station_id", "window_start", "window_end"])
    return rounded(final.select("station_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                                F.col("window_end").cast("timestamp_ntz").alias("window_end"),
                                "rain_1h", "n_readings"))


@register("stream_alerts")
def q_stream_alerts(spark, d):
    path, schema = landed_rain(spark, d)
    out = streams.scratch_path(spark, "sinks", "alerts")
    streams.run_available(streams.alert_stream(streams.ingest_stream(spark, path, schema), 5.0), out)
    return rounded(spark.read.parquet(out).drop("batch_id"))


@register("stream_insert_once")
def q_stream_insert_once(spark, d):
    """The same landing is replayed by two independent stream runs; the
    idempotent sink still holds each (station, time) once."""
    path, schema = landed_rain(spark, d)
    target = streams.scratch_path(spark, "tables", "rain_measurements")
    keys = ["station_id", "measurement_time"]
    for _ in range(2):
        streams.run_available(streams.ingest_stream(spark, path, schema, files_per_trigger=2), target,
                              batch_fn=streams.idempotent_insert(target, keys),
                              checkpoint=streams.scratch_path(spark, "checkpoints", "insert"))
    return spark.read.parquet(target).select(*keys)


@register("stream_dedup")
def q_stream_dedup(spark, d):
    """R2 over four polls: repeats of (station, time) share their event time,
    so whichever batch they arrive in, the watermark's window finds them; a
    reading behind the watermark is dropped, repeat or not."""
    rows = view(spark, d, "v_rain").select("event_id", "station_id", "measurement_time", "rain_amount_mm", "status")
    keys = ["station_id", "measurement_time"]
    out = streams.scratch_path(spark, "sinks", "dedup")
    run_landings(rows, "rain", out, lambda s: streams.dedup_stream(s, keys).select(*keys))
    return spark.read.parquet(out).select(*keys)


SESSION_GAP_HOURS = 1


@register("stream_sessions")
def q_stream_sessions(spark, d):
    """R4 over four polls: the flood sessions that the watermark has closed,
    and from the query's state those still open at its end."""
    rows = view(spark, d, "v_flow").select("basin_id", "measurement_time", "flow")
    out = streams.scratch_path(spark, "sinks", "sessions")
    run_landings(rows, "flow", out, lambda s: streams.session_stream(s, FIXTURE_FLOOD_LEVEL, f"{SESSION_GAP_HOURS} hours"))
    closed = spark.read.parquet(out).drop("batch_id").withColumn("is_open", F.lit(False))
    every = closed.unionByName(streams.open_sessions(spark, out + "_checkpoint").withColumn("is_open", F.lit(True)))
    return rounded(every.select(
        "basin_id", F.col("s.start").cast("timestamp_ntz").alias("session_start"),
        F.col("s.end").cast("timestamp_ntz").alias("session_end"), "n_readings", "peak_flow", "is_open"))


@register("live_features")
def q_live_features(spark, d):
    """The cleaned features, built from kept state as hours arrive in four landings."""
    hours = cut_lineage(merged(spark, d), "basin_hours")
    land, out = streams.scratch_path(spark, "landing", "hours"), streams.scratch_path(spark, "sinks", "live_features")
    body, start, day = live_features.feature_batches(streams.scratch_path(spark, "tables", "live_state"), out), 0, F.dayofmonth("hour")
    for end in LANDING_ENDS:
        hours.where((day > start) & (day <= end)).write.mode("append").parquet(land)
        streams.run_available(streams.ingest_stream(spark, land, hours.schema), out, batch_fn=body)
        start = end
    return rounded(spark.read.parquet(out).drop("batch_id"))


# --------------------------------------------------------------- models
LEAKY_SAME_HOUR = ["Flow_Rate_of_Change"]  # flow = lag1 + rate of change: dropped for same-hour targets


@register("align_features")
def q_align_features(spark, d):
    fc = feat.clean_features(merged(spark, d)).drop("Soil_Moisture_EWM").withColumn("extra", F.lit(1.0))
    return rounded(ml.align_features(fc, feat.FEATURE_NAMES, keep=["basin_id", "hour"]))


def model_frame(spark, d):
    fc = feat.clean_features(merged(spark, d))
    return events.time_split(events.label_now(fc, FIXTURE_FLOOD_LEVEL, out="label"), FIXTURE_SPLIT_AT)


def basins_of(frame) -> list:
    """The basins of the data: one row each, for one model each."""
    return [r[0] for r in frame.select("basin_id").distinct().orderBy("basin_id").collect()]


def rf_models(spark, d):
    frame = cut_lineage(model_frame(spark, d))  # features materialized once for all fits
    names = [n for n in feat.FEATURE_NAMES if n not in LEAKY_SAME_HOUR]
    out = []
    for b in basins_of(frame):   # one model per basin, each fit distributed
        part = frame.filter(F.col("basin_id") == b)
        model = ml.train_rf(part.filter(F.col("split") == "train"), names)
        out.append((b, model, names, part))
    return out


@register("flood_model_rf")
def q_flood_model_rf(spark, d):
    scored = None
    for b, model, names, part in rf_models(spark, d):
        bundle = ml.Bundle(basin=str(b), model_type="random_forest", flood_stage=FIXTURE_FLOOD_LEVEL,
                           feature_names=names, decision_threshold=ml.RF_DECISION)
        s = ml.score(part.filter(F.col("split") == "test"), model, bundle)
        scored = s if scored is None else scored.unionByName(s)
    return scored


@register("feature_importance")
def q_feature_importance(spark, d):
    out = None
    for b, model, names, _ in rf_models(spark, d):
        imp = ml.importances(spark, model, names).withColumn("basin_id", F.lit(b))
        out = imp if out is None else out.unionByName(imp)
    return out


@register("flow_model_gbt")
def q_flow_model_gbt(spark, d):
    """Boosted flow regressor per basin, early-stopped on the test period:
    MAE, RMSE, R2 and the flood-hour report."""
    fc = feat.clean_features(merged(spark, d))
    out = models.flow_regressor(fc, basins_of(fc), FIXTURE_FLOOD_LEVEL, FIXTURE_SPLIT_AT)
    result = None
    for b, r in out.items():
        part = r["metrics"].join(r["flood"], "basin_id").withColumn(
            "n_trees", F.lit(r["model"].stages[-1].getNumTrees))
        result = part if result is None else result.unionByName(part)
    return result


#: the reference settings take 600 rounds; the queries take few, without
#: random shares, so that SQL can follow the first split
WARNING_CHECK = boost.Settings(rounds=8, depth=3, row_share=1.0, feature_share=1.0, bins=32)
PATIENCE_CHECK = boost.Settings(rounds=16, depth=3, rate=0.5, row_share=1.0, feature_share=1.0, bins=32, min_weight=5.0, loss="squared", patience=4)


def warning(spark, d):
    return models.warn_early(rounded(feat.clean_features(merged(spark, d))), FIXTURE_FLOOD_LEVEL, FIXTURE_SPLIT_AT, settings=WARNING_CHECK)


@register("early_warning")
def q_early_warning(spark, d):
    """What each basin's model was trained on, its first split, and how many hours it scores."""
    got = warning(spark, d)
    roots = []
    for b, m in got["fitted"].models.items():      # a row a basin
        first = boost.split_thresholds(got["fitted"], b)[:1]
        t = m.trees[0]
        roots.append((b, *((first[0][1], first[0][2], first[0][3], t.value[2], t.value[3]) if first else (None,) * 5)))
    roots = spark.createDataFrame(roots, "basin_id long, root_feature string, root_threshold double, root_gain double, "
                                  "left_value double, right_value double")
    scored = got["scored"].groupBy("basin_id").agg(F.count(F.when(F.col("flood_probability").between(0, 1), 1)).alias("n_scored"))
    return rounded(got["facts"].join(roots, "basin_id", "left").join(scored, "basin_id", "left")
                   .withColumn("basin_id", F.col("basin_id").cast(got["facts"].schema["basin_id"].dataType)))


@register("early_warning_scores")
def q_early_warning_scores(spark, d):
    return warning(spark, d)["scored"]


@register("flow_model_patience")
def q_flow_model_patience(spark, d):
    """Boosted flow regressor of all basins: rounds run and kept, best error, and the metrics of the kept rounds."""
    got = models.regress_flow(rounded(feat.clean_features(merged(spark, d))), FIXTURE_FLOOD_LEVEL, FIXTURE_SPLIT_AT, settings=PATIENCE_CHECK)
    runs = spark.createDataFrame([(b, len(m.loss), len(m.trees), min(m.loss[:len(m.trees)], default=None)) for b, m in got["fitted"].models.items()],
                                 "basin_id long, rounds_run int, n_trees int, best_rmse double")
    return rounded(got["metrics"].join(got["flood"], "basin_id").join(runs, "basin_id"))


@register("features_clean_chunked")
def q_features_clean_chunked(spark, d):
    """The cleaned feature set with every basin spread over tasks: chunks of 256 hours with halos, the EWM as a tree of blocks."""
    return rounded(longseries.clean_features(merged(spark, d), rows=256, block=64, fan=8))
