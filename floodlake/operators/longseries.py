"""Hourly features of series that are too long for one task.

``operators.features`` orders a whole basin in one task. Here a basin is
spread over many:

``with_row_index``  the number of every row within its series: rows are
                    numbered within calendar chunks, and the chunks' counts
                    are summed up.
``ewm_scan``        the exponentially weighted mean as a prefix composition of
                    affine maps: a block of rows turns the mean it starts with
                    into a * y + b; blocks compose to blocks of blocks, up a
                    tree of fan ``fan``, and the starting values come down it.
``with_halo``       chunks of ``rows`` rows, each with the last rows of the
                    one before; windows that reach back no further than the
                    halo can be taken per chunk.
``clean_features``  the cleaned feature set from these parts; the same rows as
                    ``features.clean_features``.

Rows of a series have distinct times and no null ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import features as feat

#: rows of a chunk, and of the halo: the longest window is 168 rows, flow lags
#: of 24 rows look at flows judged by 24 rows
CHUNK_ROWS, HALO_ROWS = 8192, 192
CALENDAR_DAYS, FAN = 90, 256


def with_row_index(df: DataFrame, keys: Sequence[str] = ("basin_id",), order: str = "hour", days: int = CALENDAR_DAYS) -> DataFrame:
    """``df`` with ``_r``, the zero-based place of the row in its series."""
    keys = list(keys)
    x = df.withColumn("_c", F.floor(F.datediff(F.to_date(order), F.lit("1970-01-01")) / days))
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    # one row a calendar chunk
    starts = x.groupBy(*keys, "_c").agg(F.count("*").alias("_n")).select(*keys, "_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_c").orderBy(order)) - 1
    return x.join(starts, [*keys, "_c"]).withColumn("_r", F.col("_start") + inside).drop("_c", "_start")


def _fold(begin: Column | float, out: str) -> Column:
    """Over the maps ``m`` of a group in order: the value before each of them
    ("starts"), or the map of the whole group ("map"). At most ``fan`` maps."""
    if out == "map":
        start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
        return F.aggregate("m", start, lambda acc, x: F.struct((acc["a"] * x["a"]).alias("a"), (acc["b"] * x["a"] + x["b"]).alias("b")))
    start = F.struct(F.array().cast("array<double>").alias("s"), (F.lit(begin) if isinstance(begin, float) else begin).alias("y"))
    return F.aggregate("m", start, lambda acc, x: F.struct(
        F.concat(acc["s"], F.array(acc["y"])).alias("s"), (acc["y"] * x["a"] + x["b"]).alias("y")))["s"]


def _grouped(maps: DataFrame, keys: list[str], fan: int) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("i", "a", "b")))     # ``fan`` at most
    return maps.groupBy(*keys, F.floor(F.col("i") / fan).alias("up")).agg(ordered.alias("m"))


def scan_maps(maps: DataFrame, keys: Sequence[str], fan: int = FAN) -> DataFrame:
    """keys, i, start: the value with which block ``i`` (0, 1, ...) of each
    series begins, when its map is y -> a y + b and block 0 begins with 0."""
    keys = list(keys)
    levels = [cut_lineage(maps.select(*keys, "i", "a", "b"), "scan_maps")]
    while (levels[-1].agg(F.max("i")).first()[0] or 0) >= fan:
        whole = _grouped(levels[-1], keys, fan).withColumn("m", _fold(0.0, "map"))
        levels.append(cut_lineage(whole.select(*keys, F.col("up").alias("i"), "m.a", "m.b"), "scan_maps"))
    starts = _grouped(levels[-1], keys, fan).select(*keys, "m", F.lit(0.0).alias("y"))
    starts = starts.select(*keys, F.explode(F.arrays_zip(F.col("m.i").alias("i"), _fold(F.col("y"), "starts").alias("start"))).alias("e"))
    starts = starts.select(*keys, "e.i", "e.start")
    for level in reversed(levels[:-1]):
        above = cut_lineage(starts, "scan_starts").select(*keys, F.col("i").alias("up"), F.col("start").alias("y"))
        below = _grouped(level, keys, fan).join(above, [*keys, "up"])
        starts = (below.select(*keys, F.explode(F.arrays_zip(F.col("m.i").alias("i"), _fold(F.col("y"), "starts").alias("start"))).alias("e"))
                  .select(*keys, "e.i", "e.start"))
    return starts


def ewm_scan(df: DataFrame, col: str, out: str, alpha: float = feat.EWM_ALPHA, shift: int = 1, keys: Sequence[str] = ("basin_id",),
             block: int | None = None, fan: int = FAN) -> DataFrame:
    """``features.ewm`` for rows numbered by ``_r``; ``shift`` 0 or 1."""
    if shift not in (0, 1):
        raise ValueError("shift must be 0 or 1")
    keys, beta, block = list(keys), 1.0 - alpha, min(block or feat.EWM_BLOCK, feat.ewm_block(alpha))
    x = df.withColumn("_blk", F.floor(F.col("_r") / block)).withColumn("_p", F.col("_r") % block)
    v = F.when(F.col("_r") == 0, F.col(col)).otherwise(F.col(col) * alpha)
    w = Window.partitionBy(*keys, "_blk").orderBy("_r")
    local = F.pow(F.lit(beta), F.col("_p")) * F.sum(v * F.pow(F.lit(beta), -F.col("_p"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("_loc", local)
    maps = x.groupBy(*keys, F.col("_blk").alias("i")).agg(F.pow(F.lit(beta), F.count("*")).alias("a"), F.max_by("_loc", "_p").alias("b"))
    starts = scan_maps(maps, keys, fan).withColumnsRenamed({"i": "_blk", "start": "_y"})
    if shift:
        # of the row before: within the block, or the value the block begins with
        y = F.when(F.col("_p") > 0, F.lag("_loc").over(w) + F.pow(F.lit(beta), F.col("_p")) * F.col("_y")).when(F.col("_r") > 0, F.col("_y"))
    else:
        y = F.col("_loc") + F.pow(F.lit(beta), F.col("_p") + 1) * F.col("_y")
    return x.join(starts, [*keys, "_blk"]).select(*df.columns, y.alias(out))


def with_halo(df: DataFrame, keys: Sequence[str] = ("basin_id",), rows: int = CHUNK_ROWS, halo: int = HALO_ROWS) -> DataFrame:
    """Rows numbered by ``_r`` with their ``_chunk``; the last ``halo`` rows of
    a chunk come once more, as ``_halo``, in the next one."""
    if halo > rows:
        raise ValueError("a chunk must hold its halo")
    own = F.floor(F.col("_r") / rows)
    places = F.when(F.col("_r") % rows >= rows - halo, F.array(own, own + 1)).otherwise(F.array(own))
    return df.select("*", F.explode(places).alias("_chunk")).withColumn("_halo", F.col("_chunk") != own)


def chunk_features(wet: DataFrame, keys: Sequence[str] = ("basin_id",), rows: int = CHUNK_ROWS) -> DataFrame:
    """The cleaned features of rows numbered by ``_r`` that have their
    ``Soil_Moisture_EWM``, chunk by chunk; ``_r`` comes along."""
    keys = list(keys)
    part = [*keys, "_chunk"]
    df = feat.rain_features(with_halo(wet, keys, rows), part, extra=[
        F.when(~feat.suspicious_hours("flow", keys=part), F.col("flow")).alias("_flow2")])
    df = feat.flow_features(df.drop("flow").withColumnRenamed("_flow2", "flow"), "flow", part)
    cols = keys + ["hour"] + feat.FEATURE_NAMES + ["flow"]
    return df.where(~F.col("_halo")).select(*cols, "_r").dropna("any", subset=feat.FEATURE_NAMES + ["flow"])


def clean_features(merged: DataFrame, keys: Sequence[str] = ("basin_id",), rows: int = CHUNK_ROWS, block: int | None = None,
                   fan: int = FAN) -> DataFrame:
    """The rows of ``features.clean_features``, a basin spread over tasks by
    chunks of ``rows`` rows."""
    numbered = cut_lineage(with_row_index(merged, keys), "numbered_hours")
    wet = ewm_scan(numbered, "Basin_Rain_Mean", "Soil_Moisture_EWM", keys=keys, block=block, fan=fan)
    return chunk_features(wet, keys, rows).drop("_r")
