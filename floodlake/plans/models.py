"""End-to-end model plans (E2 steps 5-6): label, split, weight, fit,
evaluate and score, one model per basin.

``warn_early`` and ``regress_flow`` fit all basins together (``boost``), so
their time does not grow with the number of basins. In ``early_warning`` and
``flow_regressor`` each basin's fit is a distributed Spark ML job; the loop
runs over the basins named by the caller (a fixed, small list), never over
data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import boost, events, metrics, ml
from ..session import cut_lineage


def threshold_of(threshold: float | Mapping[int, float], basin: int) -> float:
    """One flood level for all basins, or each basin's own."""
    return threshold[basin] if isinstance(threshold, Mapping) else threshold


def early_warning(features: DataFrame, basins: Sequence[int], threshold: float | Mapping[int, float], split_at: str,
                  horizon: int = 1, decision: float = ml.GBT_EVAL_DECISION, **gbt_params) -> dict:
    """Boosted classifier for 'flood within ``horizon`` hours' per basin.
    Returns per basin: model, scored test rows, confusion, report, AUC."""
    frame = cut_lineage(events.time_split(features, split_at))
    out = {}
    for b in basins:
        level = threshold_of(threshold, b)
        part = events.label_ahead(frame.filter(F.col("basin_id") == b), level, horizon, out="label")
        model = ml.train_gbt_classifier(part.filter(F.col("split") == "train"), **gbt_params)
        bundle = ml.Bundle(basin=str(b), model_type="gbt_classifier", flood_stage=level,
                           horizon_hours=horizon, decision_threshold=decision)
        test = part.filter(F.col("split") == "test")
        scored = ml.score(test, model, bundle, keep=("basin_id", "hour", "label"), inclusive=False)
        pred = scored.withColumn("pred", F.col("alert"))
        out[b] = {
            "model": model, "bundle": bundle, "scored": scored,
            "confusion": metrics.confusion(pred),
            "report": metrics.class_report(pred),
            "auc": metrics.roc_auc(scored.withColumnRenamed("flood_probability", "proba")),
        }
    return out


# Spark ML stops boosting when the validation error improves by less than
# validationTol (relative); the closest rule to "stop once the test error no
# longer improves" is a zero tolerance (Spark has no patience window).
EARLY_STOP_TOL = 0.0


def flow_regressor(features: DataFrame, basins: Sequence[int], threshold: float | Mapping[int, float], split_at: str,
                   drop_leaky: bool = True, **gbt_params) -> dict:
    """Boosted regressor of same-hour flow per basin, early-stopped on the
    test period; reports MAE/RMSE/R2 and the flood-hour metrics."""
    gbt_params = {"validationTol": EARLY_STOP_TOL, **gbt_params}
    names = [n for n in ml.FEATURE_NAMES if not (drop_leaky and n == "Flow_Rate_of_Change")]
    frame = cut_lineage(events.time_split(features, split_at))
    out = {}
    for b in basins:
        part = frame.filter(F.col("basin_id") == b)
        train, test = part.filter(F.col("split") == "train"), part.filter(F.col("split") == "test")
        model = ml.train_gbt_regressor(train, test, names, **gbt_params)
        pred = model.transform(ml.align_features(test, names, keep=("basin_id", "hour", "flow")))
        pred = pred.select("basin_id", "hour", F.col("flow").alias("actual"), F.col("prediction").alias("predicted"))
        out[b] = {"model": model, "metrics": metrics.regression_metrics(pred),
                  "flood": metrics.flood_metrics(pred, threshold_of(threshold, b))}
    return out


def with_level(features: DataFrame, threshold: float | Mapping[int, float], out: str = "flood_level") -> DataFrame:
    """Every row with its basin's flood level (F9); a basin without one has null."""
    if not isinstance(threshold, Mapping):
        return features.withColumn(out, F.lit(float(threshold)))
    kind = features.schema["basin_id"].dataType.simpleString()
    levels = features.sparkSession.createDataFrame([(k, float(v)) for k, v in threshold.items()], f"basin_id {kind}, `{out}` double")
    return features.join(F.broadcast(levels), "basin_id", "left")     # the configured basins


def warn_early(features: DataFrame, threshold: float | Mapping[int, float], split_at: str, horizon: int = 1,
               decision: float = ml.GBT_EVAL_DECISION, settings: boost.Settings = boost.Settings(),
               names: Sequence[str] = ml.FEATURE_NAMES) -> dict:
    """Boosted classifier for 'flood within ``horizon`` hours' of all basins
    at once (M3): fitted models, the training facts of each basin, scored test
    rows, confusion, report, AUC and importances."""
    labelled = events.label_ahead(with_level(features, threshold), F.col("flood_level"), horizon, out="label")
    frame = cut_lineage(events.time_split(labelled, split_at), "early_warning")
    is_train = F.col("split") == "train"
    facts = frame.groupBy("basin_id").agg(
        F.count_if(is_train).alias("n_train"), F.count_if(~is_train).alias("n_test"),
        F.coalesce(F.sum(F.when(is_train, F.col("label"))), F.lit(0)).cast("bigint").alias("train_floods"))
    # scale_pos_weight: positives weigh negatives / max(positives, 1)
    facts = cut_lineage(facts.withColumn("scale_pos_weight", (F.col("n_train") - F.col("train_floods")) / F.greatest("train_floods", F.lit(1))),
                        "early_warning_facts")
    train = (frame.where(is_train).join(facts.select("basin_id", "scale_pos_weight"), "basin_id")
             .withColumn("weight", F.when(F.col("label") == 1, F.col("scale_pos_weight")).otherwise(1.0)))
    fitted = boost.fit_boosted(train, names, "label", "weight", settings=settings)
    scored = boost.predict(frame.where(~is_train), fitted, "flood_probability").select(
        "basin_id", "hour", "label", "flood_probability", events.decide("flood_probability", decision, inclusive=False).alias("alert"))
    pred = scored.withColumn("pred", F.col("alert"))
    return {"fitted": fitted, "facts": facts, "scored": scored, "confusion": metrics.confusion(pred), "report": metrics.class_report(pred),
            "auc": metrics.roc_auc(scored.withColumnRenamed("flood_probability", "proba")),
            "importance": boost.gain_importance(features.sparkSession, fitted)}


def regress_flow(features: DataFrame, threshold: float | Mapping[int, float], split_at: str, drop_leaky: bool = True,
                 settings: boost.Settings = boost.REGRESSOR) -> dict:
    """Boosted regressor of same-hour flow of all basins at once (M2), stopped
    early with a patience on the test period and cut back to the best round:
    fitted models, MAE/RMSE/R2 and the flood-hour metrics."""
    names = [n for n in ml.FEATURE_NAMES if not (drop_leaky and n == "Flow_Rate_of_Change")]
    frame = cut_lineage(events.time_split(with_level(features, threshold), split_at), "regress_flow")
    train, test = frame.where("split = 'train'"), frame.where("split = 'test'")
    fitted = boost.fit_boosted(train, names, "flow", valid=test, settings=settings)
    pred = boost.predict(test, fitted, "predicted").select("basin_id", "hour", F.col("flow").alias("actual"), "predicted", "flood_level")
    return {"fitted": fitted, "predicted": pred, "metrics": metrics.regression_metrics(pred),
            "flood": metrics.flood_metrics(pred, F.col("flood_level")) if isinstance(threshold, Mapping) else metrics.flood_metrics(pred, threshold)}
