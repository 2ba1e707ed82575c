"""Model evaluation as aggregations.

All metrics are grouped by a key (basin) so every model is scored in one
job. ROC-AUC uses a distributed prefix sum over score ranges of about equal
size, so a basin holding a large share of the rows is spread across tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

AUC_RANGES = 256


def _safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0)).cast("double")


def class_balance(df: DataFrame, label: str = "label", keys: Sequence[str] = ("basin_id",)) -> DataFrame:
    """Positives, their share in %, and ``scale_pos_weight = neg / max(pos, 1)``."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                              F.sum(F.col(label).cast("long")).alias("positives"))
    neg = F.col("n") - F.col("positives")
    return g.select(*keys, F.col("n").alias("rows"), F.col("positives").cast("bigint").alias("positives"),
                    (F.col("positives") * 100.0 / F.col("n")).alias("positive_pct"),
                    (neg / F.greatest(F.col("positives"), F.lit(1))).cast("double").alias("scale_pos_weight"))


def class_weights(df: DataFrame, label: str = "label", keys: Sequence[str] = ("basin_id",)) -> DataFrame:
    """Per key and class: balanced weight ``n / (n_classes * n_class)`` (n_classes = 2)
    and the positive-class boost ``neg / max(pos, 1)``."""
    keys = list(keys)
    per = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n_class"))
    tot = per.groupBy(*keys).agg(
        F.sum("n_class").alias("n"),
        F.sum(F.when(F.col(label) == 1, F.col("n_class")).otherwise(0)).alias("pos"))
    return (per.join(tot, keys)
            .select(*keys, F.col(label).cast("int").alias("label"), F.col("n_class").cast("bigint").alias("n_class"),
                    (F.col("n") / (2.0 * F.col("n_class"))).alias("balanced_weight"),
                    F.when(F.col(label) == 1, (F.col("n") - F.col("pos")) / F.greatest(F.col("pos"), F.lit(1)))
                    .otherwise(F.lit(1.0)).cast("double").alias("boost_weight")))


def confusion(df: DataFrame, label: str = "label", pred: str = "pred",
              keys: Sequence[str] = ("basin_id",)) -> DataFrame:
    """Full 2x2 grid of (actual, predicted) counts, zeros included."""
    g = df.groupBy(*keys).agg(*[
        F.sum(((F.col(label) == a) & (F.col(pred) == p)).cast("long")).alias(f"c{a}{p}")
        for a in (0, 1) for p in (0, 1)])
    cells = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"),
                               F.col(f"c{a}{p}").cast("bigint").alias("n")) for a in (0, 1) for p in (0, 1)])
    return g.select(*keys, F.inline(cells))


def class_report(df: DataFrame, label: str = "label", pred: str = "pred",
                 keys: Sequence[str] = ("basin_id",)) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and
    weighted averages; a zero division gives 0."""
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(((F.col(label) == a) & (F.col(pred) == p)).cast("long")).alias(f"c{a}{p}")
          for a in (0, 1) for p in (0, 1)])
    rows = []
    stats = {}
    for c in (0, 1):
        o = 1 - c
        tp, fp, fn = F.col(f"c{c}{c}"), F.col(f"c{o}{c}"), F.col(f"c{c}{o}")
        prec = _safe_div(tp, tp + fp)
        rec = _safe_div(tp, tp + fn)
        f1 = _safe_div(2 * prec * rec, prec + rec)
        sup = tp + fn
        stats[c] = (prec, rec, f1, sup)
        rows.append(F.struct(F.lit(str(c)).alias("class"), prec.alias("precision"), rec.alias("recall"),
                             f1.alias("f1"), sup.cast("bigint").alias("support")))
    acc = _safe_div(F.col("c00") + F.col("c11"), F.col("n"))
    rows.append(F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                         F.lit(None).cast("double").alias("recall"), acc.alias("f1"),
                         F.col("n").cast("bigint").alias("support")))
    for name, weight in (("macro avg", None), ("weighted avg", "support")):
        parts = []
        for i in range(3):
            if weight is None:
                parts.append((stats[0][i] + stats[1][i]) / 2)
            else:
                parts.append(_safe_div(stats[0][i] * stats[0][3] + stats[1][i] * stats[1][3], F.col("n")))
        rows.append(F.struct(F.lit(name).alias("class"), parts[0].cast("double").alias("precision"),
                             parts[1].cast("double").alias("recall"), parts[2].cast("double").alias("f1"),
                             F.col("n").cast("bigint").alias("support")))
    return g.select(*keys, F.inline(F.array(*rows)))


def _range_of(bounds: Column, x: Column, ranges: int) -> Column:
    """Number of the sorted ``bounds`` (``ranges`` - 1 of them) that are
    smaller than ``x``: a binary search of log2 steps."""
    steps = [2 ** k for k in reversed(range((ranges - 1).bit_length()))]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when(
        F.get(bounds, at + s - 1) < x, at + s).otherwise(at))


def roc_auc(df: DataFrame, label: str = "label", score: str = "proba",
            keys: Sequence[str] = ("basin_id",), ranges: int = AUC_RANGES) -> DataFrame:
    """Area under the ROC curve with tied scores averaged (Mann-Whitney):
    sum over scores of pos(s) * (neg below s + neg(s) / 2) / (P * N).

    Counts are pre-aggregated per distinct score and written once. The scores
    of a key are cut into ``ranges`` at quantiles of its distinct scores, found by a sketch, so a range has about as many scores as
    any other however closely they crowd. The running count of negatives is
    the sum over the ranges before plus the one inside the range: one task
    orders a range, or the ``ranges`` totals of a key, never a whole basin.
    """
    keys = list(keys)
    s = F.col(score).cast("double")
    per = cut_lineage(df.groupBy(*keys, s.alias("_s")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"),
        F.sum((1 - F.col(label)).cast("long")).alias("neg")), "auc_scores")
    probs = [k / ranges for k in range(1, ranges)]
    bounds = per.groupBy(*keys).agg(F.percentile_approx("_s", probs, 10 * ranges).alias("_bounds"))
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    ranged = per.alias("p").join(bounds.alias("b"), reduce(and_, same)).select(
        *[F.col(f"p.{k}").alias(k) for k in keys], "_s", "pos", "neg",
        F.coalesce(_range_of(F.col("_bounds"), F.col("_s"), ranges), F.lit(0)).alias("_b"))
    totals = ranged.groupBy(*keys, "_b").agg(F.sum("neg").alias("_bneg"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_b", F.coalesce(F.sum("_bneg").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    x = ranged.withColumn("_in", F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    # inside a range the offset is the same for all scores: add it once a range
    parts = x.groupBy(*keys, "_b").agg(F.sum(F.col("pos") * (F.col("_in") + F.col("neg") / 2.0)).alias("_u"),
                                       F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"t.{k}")) for k in [*keys, "_b"]]
    g = (parts.alias("x").join(totals.alias("t"), reduce(and_, same))
         .groupBy(*[F.col(f"x.{k}").alias(k) for k in keys]).agg(
             F.sum(F.col("_u") + F.col("_pos") * F.col("_off")).alias("_u"), F.sum("_pos").alias("P"), F.sum("_neg").alias("N")))
    return g.select(*keys, F.when((F.col("P") > 0) & (F.col("N") > 0),
                                  F.col("_u") / (F.col("P") * F.col("N"))).alias("roc_auc"),
                    F.col("P").cast("bigint").alias("positives"), F.col("N").cast("bigint").alias("negatives"))


def regression_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                       keys: Sequence[str] = ("basin_id",), clip_at_zero: bool = True) -> DataFrame:
    """MAE, RMSE and R^2 = 1 - SSE / SST on predictions clipped at 0."""
    p = F.greatest(F.col(predicted), F.lit(0.0)) if clip_at_zero else F.col(predicted)
    err = F.col(actual) - p
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"),
        F.avg(err * err).alias("mse"), F.sum(err * err).alias("sse"),
        (F.var_pop(actual) * F.count(F.lit(1))).alias("sst"))
    return g.select(*keys, "n", "mae", F.sqrt("mse").alias("rmse"),
                    (1 - F.col("sse") / F.col("sst")).alias("r2"))


def flood_metrics(df: DataFrame, threshold: float, actual: str = "actual", predicted: str = "predicted",
                  keys: Sequence[str] = ("basin_id",)) -> DataFrame:
    """Flood-hour report: real flood hours, hits, misses, false alarms,
    recall and MAE inside flood hours; zeros when a key has no flood hour."""
    p = F.greatest(F.col(predicted), F.lit(0.0))
    real = F.col(actual) > threshold
    hit = p > threshold
    g = df.groupBy(*keys).agg(
        F.sum(real.cast("long")).alias("flood_hours"),
        F.sum((real & hit).cast("long")).alias("true_pos"),
        F.sum((~real & hit).cast("long")).alias("false_pos"),
        F.sum(F.when(real, F.abs(F.col(actual) - p))).alias("_abs"))
    return g.select(*keys, F.col("flood_hours").cast("bigint").alias("flood_hours"),
                    F.col("true_pos").cast("bigint").alias("true_pos"),
                    (F.col("flood_hours") - F.col("true_pos")).cast("bigint").alias("false_neg"),
                    F.col("false_pos").cast("bigint").alias("false_pos"),
                    _safe_div(F.col("true_pos") * 100.0, F.col("flood_hours")).alias("recall_pct"),
                    _safe_div(F.col("_abs"), F.col("flood_hours")).alias("flood_mae"))
