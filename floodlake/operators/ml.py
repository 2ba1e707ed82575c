"""Flood models with Spark ML.

Training is distributed by Spark ML (trees are built from per-partition
statistics, no data passes through the driver). A model bundle is a
saved ``PipelineModel`` plus one JSON metadata row written next to it.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import FEATURE_NAMES

# Model settings of the three model generations, the
# scoring defaults and the decision thresholds.
RF_PARAMS = dict(numTrees=200, maxDepth=10, seed=42)
GBT_REGRESSOR_PARAMS = dict(maxIter=1000, stepSize=0.05, maxDepth=6, subsamplingRate=0.8,
                            featureSubsetStrategy="0.8", minInstancesPerNode=5, seed=42)
GBT_CLASSIFIER_PARAMS = dict(maxIter=600, stepSize=0.05, maxDepth=5, subsamplingRate=0.8,
                             featureSubsetStrategy="0.8", seed=42)
DEFAULT_HORIZON = 3
DEFAULT_DECISION = 0.03
RF_DECISION = 0.5
GBT_EVAL_DECISION = 0.3


@dataclass
class Bundle:
    basin: str
    model_type: str
    flood_stage: float
    feature_names: list[str] = field(default_factory=lambda: list(FEATURE_NAMES))
    horizon_hours: int | None = None
    decision_threshold: float | None = None
    metrics: dict = field(default_factory=dict)

    def horizon(self) -> int:
        return DEFAULT_HORIZON if self.horizon_hours is None else self.horizon_hours

    def decision(self) -> float:
        """The stored threshold. A bundle without one is refused: the default
        of the scoring job is far from what its model was tuned for."""
        if self.decision_threshold is None:
            raise ValueError(f"the bundle of basin {self.basin} has no decision_threshold "
                             f"(the scoring job's default is {DEFAULT_DECISION})")
        return self.decision_threshold


def feature_columns(df: DataFrame, target: Sequence[str] = ("flow",),
                    keys: Sequence[str] = ("basin_id", "hour")) -> list[str]:
    """Feature columns: everything but keys and target columns."""
    drop = set(target) | set(keys)
    return [c for c in df.columns if c not in drop]


def align_features(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly ``names`` in that order: a missing feature becomes 0.0,
    extra columns are dropped (``keep`` columns are carried along)."""
    have = set(df.columns)
    cols: list[Column] = [F.col(k) for k in keep]
    for n in names:
        cols.append((F.col(n).cast("double") if n in have else F.lit(0.0)).alias(n))
    return df.select(*cols)


def _class_counts(df: DataFrame, label: str) -> tuple[int, int]:
    """(rows, positives): one scalar aggregate, partial counts per task."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("p")).first()
    return int(row["n"]), int(row["p"] or 0)


def balanced_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """``n / (2 * n_class)`` per row (class_weight='balanced')."""
    n, p = _class_counts(df, label)
    w_pos = n / (2.0 * p) if p else 0.0
    w_neg = n / (2.0 * (n - p)) if n - p else 0.0
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(w_pos)).otherwise(F.lit(w_neg)))


def positive_boost(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """``scale_pos_weight``: positives weigh neg / max(pos, 1), negatives 1."""
    n, p = _class_counts(df, label)
    spw = (n - p) / max(p, 1)
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(float(spw))).otherwise(F.lit(1.0)))


def _assembler(names: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(names), outputCol="features", handleInvalid="keep")


def train_rf(df: DataFrame, names: Sequence[str] = FEATURE_NAMES, label: str = "label", **params) -> PipelineModel:
    """Random forest (M1) with balanced class weights."""
    est = RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="weight",
                                 **{**RF_PARAMS, **params})
    return Pipeline(stages=[_assembler(names), est]).fit(balanced_weights(df, label))


def train_gbt_regressor(train: DataFrame, valid: DataFrame | None = None, names: Sequence[str] = FEATURE_NAMES,
                        label: str = "flow", **params) -> PipelineModel:
    """Boosted regressor (M2); with ``valid`` rows it stops early on them."""
    kw = {**GBT_REGRESSOR_PARAMS, **params}
    if valid is not None:
        data = train.withColumn("_valid", F.lit(False)).unionByName(valid.withColumn("_valid", F.lit(True)))
        est = GBTRegressor(featuresCol="features", labelCol=label, validationIndicatorCol="_valid", **kw)
    else:
        data = train
        est = GBTRegressor(featuresCol="features", labelCol=label, **kw)
    return Pipeline(stages=[_assembler(names), est]).fit(data)


def train_gbt_classifier(df: DataFrame, names: Sequence[str] = FEATURE_NAMES, label: str = "label",
                         **params) -> PipelineModel:
    """Boosted classifier (M3) with ``scale_pos_weight`` as row weights."""
    est = GBTClassifier(featuresCol="features", labelCol=label, weightCol="weight",
                        **{**GBT_CLASSIFIER_PARAMS, **params})
    return Pipeline(stages=[_assembler(names), est]).fit(positive_boost(df, label))


def probability(df: DataFrame, out: str = "flood_probability") -> DataFrame:
    """Probability of class 1 as a double column (M5)."""
    return df.withColumn(out, vector_to_array("probability")[1])


def score(df: DataFrame, model: PipelineModel, bundle: Bundle, keep: Sequence[str] = ("basin_id", "hour"),
          inclusive: bool = True) -> DataFrame:
    """Align features, predict, decide."""
    x = align_features(df, bundle.feature_names, keep)
    p = probability(model.transform(x))
    thr = bundle.decision()
    decision = (F.col("flood_probability") >= thr) if inclusive else (F.col("flood_probability") > thr)
    return p.select(*keep, "flood_probability", decision.cast("int").alias("alert"))


def importances(spark: SparkSession, model: PipelineModel, names: Sequence[str]) -> DataFrame:
    """Feature importances with names, ascending (M7)."""
    vec = model.stages[-1].featureImportances
    rows = [(n, float(vec[i])) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy("importance", "feature")


def save_bundle(spark: SparkSession, model: PipelineModel, bundle: Bundle, path: str) -> None:
    """Model and metadata side by side (K6); works on any Hadoop path."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(asdict(bundle)),)], "meta string").coalesce(1) \
        .write.mode("overwrite").text(f"{path}/meta")


def load_bundle(spark: SparkSession, path: str) -> tuple[PipelineModel, Bundle]:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return PipelineModel.load(f"{path}/model"), Bundle(**meta)
