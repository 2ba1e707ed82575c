"""Parsing and calendar expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Timestamp layouts of the raw rain and flow files, and the
# forecast window grid (windows start at 03, 09, 15, 21).
RAIN_TIME_PATTERNS = ["dd/MM/yyyy HH:mm", "d/M/yyyy H:mm"]
FLOW_TIME_PATTERNS = ["dd/MM/yyyy HH:mm:ss", "d/M/yyyy H:mm:ss"]
FORECAST_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
WINDOW_HOURS = 6
WINDOW_OFFSET_HOURS = 3


def parse_number(c: Column, default: float | None = 0.0) -> Column:
    """Text -> double; unparsable -> ``default`` (no error under ANSI)."""
    v = F.trim(c).try_cast("double")
    v = F.when(F.isnan(v), F.lit(None)).otherwise(v)  # NaN never enters a frame
    return v if default is None else F.coalesce(v, F.lit(default))


def parse_time(c: Column, patterns: Sequence[str]) -> Column:
    """Text -> TIMESTAMP_NTZ using the first pattern that parses; NULL if none."""
    tries = [F.try_to_timestamp(c, F.lit(p)) for p in patterns]
    return F.coalesce(*tries).cast("timestamp_ntz")


def window_start(ts: Column) -> Column:
    """Start of the 6-hour forecast window holding ``ts`` (03, 09, 15, 21;
    before 03:00 it is 21:00 of the previous day)."""
    shifted = ts.cast("timestamp_ntz") - F.expr(f"INTERVAL {WINDOW_OFFSET_HOURS} HOURS")
    day = F.to_date(shifted).cast("timestamp_ntz")   # no zone, so no hour is lost on the day the clock changes
    k = F.floor(F.hour(shifted) / WINDOW_HOURS).cast("int")
    return (day + F.make_dt_interval(hours=k * WINDOW_HOURS + WINDOW_OFFSET_HOURS)).cast("timestamp_ntz")


def forecast_windows(ts: Column) -> tuple[Column, Column]:
    """(current, next) window starts for a point in time."""
    cur = window_start(ts)
    return cur, (cur + F.expr(f"INTERVAL {WINDOW_HOURS} HOURS")).cast("timestamp_ntz")


def as_text(ts: Column) -> Column:
    return F.date_format(ts, FORECAST_TIME_FORMAT)
