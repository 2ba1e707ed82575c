"""Features and scores of the newest hours from kept state.

The state of a basin is its last ``HALO_ROWS`` hours, as no feature looks
further back, and on every row the soil-moisture mean up to it, as that looks
back for ever. Hours that arrive are put behind them, the features of the new
rows are built as for a whole history (``longseries``), and the last hours
become the next state. The soil-moisture mean of the joined rows starts anew
at the first kept row; what it lacks is the kept mean less that row's rain,
which fades by (1 - alpha) a row.

The state is a versioned table and every batch publishes one version that
carries the batch's number: a batch that is run again starts from the version
before it, writes the same rows, and changes no state.

Defined cases: hours must arrive in order for each basin; an hour not later
than the newest kept one of its basin is dropped, and so is one without a
basin or time; of hours that a batch holds twice one stays. The lead-in hours
of a new basin have no features. A first batch may hold a whole history: it
is spread over tasks like any long series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as feat
from ..operators import longseries
from ..session import cut_lineage
from ..sinks.versions import VersionedTable
from .streams import batch_folder

WRITER = "live_features"


def advance(state: DataFrame | None, hours: DataFrame, keys: Sequence[str] = ("basin_id",),
            halo: int = longseries.HALO_ROWS) -> tuple[DataFrame, DataFrame]:
    """Features of the new ``hours`` (basin-hour rows), and the next state."""
    keys = list(keys)
    new = (hours.dropna("any", subset=[*keys, "hour"]).dropDuplicates([*keys, "hour"])
           .select(*hours.columns, F.lit(None).cast("double").alias("_mean"), F.lit(True).alias("_new")))
    if state is not None:
        newest = state.groupBy(*keys).agg(F.max("hour").alias("_newest"))      # one row a basin
        new = new.join(newest, keys, "left").where("_newest is null or hour > _newest").drop("_newest")
        new = state.withColumn("_new", F.lit(False)).unionByName(new)
    numbered = cut_lineage(longseries.with_row_index(new, keys), "live_hours")
    beta, rain = 1.0 - feat.EWM_ALPHA, F.col("Basin_Rain_Mean")
    wet = longseries.ewm_scan(numbered, "Basin_Rain_Mean", "Soil_Moisture_EWM", keys=keys)
    ends = numbered.groupBy(*keys).agg(F.max("_r").alias("_last"),
                                       F.max(F.when(F.col("_r") == 0, F.col("_mean") - rain)).alias("_lacks"))
    wet = cut_lineage(wet.join(ends, keys).withColumn(
        "Soil_Moisture_EWM", F.col("Soil_Moisture_EWM") + F.coalesce("_lacks", F.lit(0.0)) * F.pow(F.lit(beta), F.col("_r") - 1)), "live_wet")
    mean = F.when(F.col("_r") == 0, F.coalesce("_mean", rain)).otherwise(
        beta * F.col("Soil_Moisture_EWM") + feat.EWM_ALPHA * rain)
    kept = wet.where(F.col("_r") > F.col("_last") - halo).select(*hours.columns, mean.alias("_mean"))
    fresh = wet.where("_new").select(*keys, "_r")
    built = longseries.chunk_features(wet.drop("_new", "_mean", "_last", "_lacks"), keys)
    return built.join(fresh, [*keys, "_r"], "left_semi").drop("_r"), kept


def feature_batches(state_path: str, out_path: str, predict: Callable[[DataFrame], DataFrame] | None = None,
                    keys: Sequence[str] = ("basin_id",)) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: the features of the batch's hours, through
    ``predict`` if given (``ml.score`` or ``boost.predict`` with a loaded
    model), as that batch's folder of ``out_path``."""
    write = batch_folder(out_path)

    def fn(batch: DataFrame, batch_id: int) -> None:
        table = VersionedTable(batch.sparkSession, state_path)
        before = [v for v in table.versions() if table.manifest(v)["txn"].get(WRITER, -1) < batch_id]
        built, state = advance(table.read(before[-1]) if before else None, batch, keys)
        write(predict(built) if predict else built, batch_id)
        table.replace(state, txn=(WRITER, batch_id))
        table.expire(keep=2)      # this batch's version and the one it would start from again
    return fn
