"""Trees for all basins at once (M1, M2, M3, M7): level-wise histogram fits.

Every basin has a model of its own, but no basin a fit of its own: one job
grows one level of the trees of all basins. Features are cut into quantile
bins per basin once (exact, by ``selection``). For a level, every row finds
its node by walking the tree so far, and one aggregate sums gradients and
weights over (basin, tree, node, feature, bin), combined in every task
before the shuffle. Split choice runs over that small table with window sums;
only the chosen splits, a row per node, come to the driver, where the models
live as in Spark ML. So the number of jobs does not depend on the number of
basins, and a basin that holds a third of the rows is spread like any other.

``fit_boosted``  gradient boosting, logistic or squared loss, second-order
                 gains, row and feature shares, positive weights, and early
                 stopping with a patience: the loss after every prefix of the
                 new trees is one pass over the validation rows (``staged_loss``),
                 a basin whose loss has not improved for ``patience`` rounds
                 stops, and its model is cut back to the best round.
``fit_forest``   bagged trees on Poisson row weights with a random choice of
                 features a node; the trees of a block grow together.

Rows need the key column, the order column and the features; a null feature
lies in the lowest bin. A basin without training rows has no model, and its
rows score null.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import selection

#: rounds between writing the margins out (later rounds walk at most so many trees a row)
STRETCH = 8
#: trees of a forest that grow together; basins fitted together
FOREST_BLOCK, BASIN_BLOCK = 20, 10_000


@dataclass(frozen=True)
class Settings:
    """Defaults are those of the early-warning classifier."""
    rounds: int = 600
    depth: int = 5
    rate: float = 0.05
    row_share: float = 0.8
    feature_share: float = 0.8
    min_weight: float = 1.0
    l2: float = 1.0
    bins: int = 64
    loss: str = "logistic"
    seed: int = 42
    patience: int | None = None


#: the flow regressor's settings
REGRESSOR = Settings(rounds=1000, depth=6, min_weight=5.0, loss="squared", patience=50)
#: the forest's: plain mean of the leaf, no shrinkage
FOREST = Settings(rounds=200, depth=10, rate=1.0, row_share=1.0, l2=0.0, min_weight=0.0, loss="squared")


@dataclass
class Tree:
    """A binary heap: node 1 is the root, 2 k and 2 k + 1 its children; feature -1 marks a leaf."""
    depth: int
    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def __post_init__(self) -> None:
        n = 2 << self.depth
        self.feature, self.cut = self.feature or [-1] * n, self.cut or [0] * n
        self.value, self.gain = self.value or [0.0] * n, self.gain or [0.0] * n


@dataclass
class Model:
    """The trees of one basin; ``edges`` hold the upper borders of each feature's bins."""
    base: float
    edges: list[list[float]]
    trees: list[Tree] = field(default_factory=list)
    loss: list[float] = field(default_factory=list)     # of the validation rows after each round
    best: int | None = None                             # rounds that stay, with a patience


@dataclass
class Fitted:
    """Models of all basins and what is needed to apply them."""
    key: str
    order: str
    names: list[str]
    settings: Settings
    models: dict
    forest: bool = False


# ---------------------------------------------------------------- binning

def bin_edges(df: DataFrame, names: Sequence[str], bins: int, key: str = "basin_id") -> DataFrame:
    """key, edges: per feature the distinct values at the ranks floor(k (n - 1) / bins), 0 < k < bins."""
    long = df.select(key, F.posexplode(F.array(*[F.col(n).cast("double") for n in names])).alias("feature", "v"))
    ranks = F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda k: F.floor(k * (F.col("n") - 1) / bins))
    found = selection.order_statistics(cut_lineage(long, "boost_values"), "v", ranks, [key, "feature"])
    per = found.groupBy(key, "feature").agg(F.array_sort(F.collect_set("value")).alias("e"))
    by = per.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("feature", "e"))).alias("m"))
    return by.select(key, F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda f: F.coalesce(
        F.get(F.array(F.col("m")), 0)[f], F.array().cast("array<double>"))).alias("edges"))


def binned(df: DataFrame, edges: DataFrame, names: Sequence[str], key: str, keep: Sequence[Column | str]) -> DataFrame:
    """``keep`` columns and ``bins``: for each feature how many edges lie below its value."""
    values = F.array(*[F.col(n).cast("double") for n in names])
    # edges: one row a basin, from the driver's models or a written table
    return (df.join(edges, key).withColumn("_v", values)
            .select(*keep, F.expr("transform(_v, (x, f) -> size(filter(edges[f], e -> e < x)))").alias("bins"))
            .withColumn("bins", F.expr("transform(bins, b -> CAST(greatest(b, 0) AS INT))")))


# ------------------------------------------------------------------ trees

_WALK = ("aggregate(sequence(1, {depth}), 1, (k, i) -> CASE WHEN {t}.f[k] < 0 THEN k "
         "WHEN bins[{t}.f[k]] <= {t}.c[k] THEN 2 * k ELSE 2 * k + 1 END)")
_TREE_TYPE = "struct<f: array<int>, c: array<int>, v: array<double>>"


def _driver_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of the driver's models, as one constant: unlike
    ``createDataFrame`` it needs no Python worker to be read."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _walkable(tree: Tree) -> dict:
    return {"f": tree.feature, "c": tree.cut, "v": tree.value}


def grow(rows: DataFrame, targets: list[tuple], settings: Settings, key: str, n_features: int,
         features: Column | None = None, per_node: int | None = None) -> dict[tuple, Tree]:
    """Trees for all (key, tree) of ``targets`` from ``rows``: key, tree,
    bins, g (gradient) and h (weight). ``features``: which feature numbers
    may split (column ``feature``); ``per_node``: so many at random per node."""
    spark, key_type = rows.sparkSession, rows.schema[key].dataType.simpleString()
    trees = {t: Tree(settings.depth) for t in targets}
    open_ = {t: {1} for t in targets}
    lam = settings.l2
    for level in range(settings.depth):
        growing = [t for t in targets if open_[t]]
        if not growing:
            break
        known = _driver_rows(spark, [{key: t[0], "tree": t[1], "t": _walkable(trees[t])} for t in growing],
                             f"`{key}`: {key_type}, tree: int, t: {_TREE_TYPE}")
        node = F.expr(_WALK.format(depth=level, t="t")) if level else F.lit(1)
        # bounded: a row for each tree that grows now
        at = (rows.join(F.broadcast(known), [key, "tree"]).withColumn("node", node).where(F.col("node") >= 1 << level)
              .select(key, "tree", "node", "g", "h", F.posexplode("bins").alias("feature", "bin")))
        if features is not None:
            at = at.where(features)
        by = [key, "tree", "node"]
        hist = at.groupBy(*by, "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))
        if per_node:
            rank = F.dense_rank().over(Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(settings.seed), *by, "feature")))
            hist = hist.withColumn("_r", rank).where(F.col("_r") <= per_node).drop("_r")
        best = best_splits(hist, by, lam, settings.min_weight)
        for r in best.collect():        # a row per node
            tree, k = trees[(r[key], r.tree)], r.node
            if level == 0:
                tree.value[1] = -settings.rate * r.G / (r.H + lam) if r.H + lam else 0.0
            if r.gain is None or r.gain <= 1e-9:
                continue
            tree.feature[k], tree.cut[k], tree.gain[k] = r.feature, r.bin, r.gain
            tree.value[2 * k] = -settings.rate * r.gl / (r.hl + lam)
            tree.value[2 * k + 1] = -settings.rate * r.gr / (r.hr + lam)
        for t in growing:
            open_[t] = {c for k in open_[t] if trees[t].feature[k] >= 0 for c in (2 * k, 2 * k + 1)}
    return trees


def best_splits(hist: DataFrame, by: Sequence[str], l2: float, min_weight: float) -> DataFrame:
    """by, G, H, and the best split of every node: feature, bin (the last one
    that goes left), gain = GL^2/(HL+l) + GR^2/(HR+l) - G^2/(H+l), the sums of
    its two sides. Equal gains go to the first feature, then the lowest bin."""
    up = Window.partitionBy(*by, "feature").orderBy("bin")
    whole = Window.partitionBy(*by, "feature")
    s = hist.select(*by, "feature", "bin", F.sum("g").over(up).alias("gl"), F.sum("h").over(up).alias("hl"), F.sum("n").over(up).alias("nl"),
                    F.sum("g").over(whole).alias("G"), F.sum("h").over(whole).alias("H"), F.sum("n").over(whole).alias("N"))
    s = s.withColumn("gr", F.col("G") - F.col("gl")).withColumn("hr", F.col("H") - F.col("hl"))
    part = lambda g, h: F.try_divide(F.col(g) * F.col(g), F.col(h) + F.lit(l2))
    ok = (F.col("nl") < F.col("N")) & (F.col("hl") >= min_weight) & (F.col("hr") >= min_weight) & (F.col("hl") > 0) & (F.col("hr") > 0)
    gain = F.when(ok, part("gl", "hl") + part("gr", "hr") - part("G", "H"))
    order = F.struct(F.coalesce(F.round(gain, 9), F.lit(-1.0)).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))
    pick = F.max_by(F.struct(gain.alias("gain"), "feature", "bin", "gl", "hl", "gr", "hr"), order)
    return s.groupBy(*by).agg(F.first("G").alias("G"), F.first("H").alias("H"), pick.alias("s")).select(*by, "G", "H", "s.*")


# --------------------------------------------------------------- boosting

def _with_margin(rows: DataFrame, pending: dict, key: str, depth: int) -> DataFrame:
    """``margin`` with the leaf values of the pending trees of each basin added."""
    if not any(pending.values()):
        return rows
    key_type = rows.schema[key].dataType.simpleString()
    table = _driver_rows(rows.sparkSession, [{key: k, "ts": [_walkable(t) for t in ts]} for k, ts in pending.items()],
                         f"`{key}`: {key_type}, ts: array<{_TREE_TYPE}>")
    sums = F.expr(f"aggregate(ts, CAST(0 AS DOUBLE), (m, t) -> m + t.v[{_WALK.format(depth=depth, t='t')}])")
    # bounded: one row a basin, STRETCH trees each
    return rows.join(F.broadcast(table), key, "left").withColumn("margin", F.col("margin") + F.coalesce(sums, F.lit(0.0))).drop("ts")


def _gradients(loss: str, weight: Column) -> tuple[Column, Column]:
    if loss == "squared":
        return weight * (F.col("margin") - F.col("y")), weight
    p = 1 / (1 + F.exp(-F.col("margin")))
    return weight * (p - F.col("y")), F.greatest(weight * p * (1 - p), F.lit(1e-16))


def _loss(loss: str, margin: Column) -> Column:
    """A row's part of the loss: log loss, or the squared error."""
    if loss == "squared":
        return (margin - F.col("y")) * (margin - F.col("y"))
    # log(1 + e^m) - y m, without overflow
    return F.greatest(margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin))) - F.col("y") * margin


def staged_loss(rows: DataFrame, pending: dict, key: str, depth: int, loss: str) -> dict:
    """key -> mean loss (for "squared" its root) after 1, 2, ... of the
    pending trees; one pass over the rows (key, bins, y, margin)."""
    if not any(pending.values()):
        return {}
    key_type = rows.schema[key].dataType.simpleString()
    table = _driver_rows(rows.sparkSession, [{key: k, "ts": [_walkable(t) for t in ts]} for k, ts in pending.items()],
                         f"`{key}`: {key_type}, ts: array<{_TREE_TYPE}>")
    steps = F.expr("aggregate(ts, CAST(array(margin) AS ARRAY<DOUBLE>), (a, t) -> concat(a, array(element_at(a, -1) + t.v["
                   + _WALK.format(depth=depth, t="t") + "])))")
    curve = (rows.join(F.broadcast(table), key).select(key, "y", F.posexplode(F.slice(steps, 2, 1 << 20)).alias("k", "m"))
             .groupBy(key, "k").agg(F.avg(_loss(loss, F.col("m"))).alias("loss")))
    out: dict = {}
    for r in curve.orderBy("k").collect():      # a number a basin and round
        out.setdefault(r[key], []).append(math.sqrt(r.loss) if loss == "squared" else r.loss)
    return out


def stop_at(loss: Sequence[float], patience: int) -> tuple[int, bool]:
    """Rounds that stay, and whether to stop: the best round is kept once none
    of the ``patience`` rounds after it was better."""
    best = min(range(len(loss)), key=lambda k: (loss[k], k))
    for k in range(len(loss)):
        first = min(range(k + 1), key=lambda j: (loss[j], j))
        if k - first >= patience:
            return first + 1, True
    return best + 1, False


def _features_of(settings: Settings, n: int, tree: int) -> Column | None:
    """The features of one tree: a share of them, by a hash of seed, tree and number."""
    if settings.feature_share >= 1:
        return None
    some = sorted(range(n), key=lambda f: zlib.crc32(f"{settings.seed}:{tree}:{f}".encode()))[:max(1, math.ceil(settings.feature_share * n))]
    return F.col("feature").isin(some)


def _sampled(settings: Settings, key: str, tree: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(settings.seed), F.lit(tree), key, "_order"), F.lit(1_000_000)) < int(settings.row_share * 1_000_000)


def _blocks(keys: list, size: int) -> Iterator[list]:
    for at in range(0, len(keys), size):
        yield keys[at:at + size]


def _prepare(train: DataFrame, names: Sequence[str], label: str, weight: str | None, settings: Settings, key: str,
             order: str) -> tuple[DataFrame, DataFrame, dict]:
    """Binned training rows, edges, and a model without trees per basin."""
    edges = cut_lineage(bin_edges(train, names, settings.bins, key), "boost_edges")
    keep = [key, F.col(order).alias("_order"), F.col(label).cast("double").alias("y"),
            (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w")]
    rows = cut_lineage(binned(train, edges, names, key, keep), "boost_rows")
    means = {r[key]: r.m for r in rows.groupBy(key).agg(F.avg("y").alias("m")).collect()}      # one row a basin
    base = (lambda m: m) if settings.loss == "squared" else (lambda m: 0.0)
    return rows, edges, {r[key]: Model(base(means[r[key]]), r.edges) for r in edges.orderBy(key).collect() if r[key] in means}


def _bases(rows: DataFrame, models: dict, key: str) -> DataFrame:
    """The models' starting margins beside the rows of their basins."""
    key_type = rows.schema[key].dataType.simpleString()
    base = _driver_rows(rows.sparkSession, [{key: k, "margin": m.base} for k, m in models.items()], f"`{key}`: {key_type}, margin: double")
    return rows.join(F.broadcast(base), key)


def fit_boosted(train: DataFrame, names: Sequence[str], label: str = "label", weight: str | None = None,
                valid: DataFrame | None = None, settings: Settings = Settings(), key: str = "basin_id", order: str = "hour") -> Fitted:
    """Boosted trees for every basin of ``train``; with ``valid`` rows and a
    patience the rounds of each basin stop early."""
    names = list(names)
    all_rows, edges, models = _prepare(train, names, label, weight, settings, key, order)
    for some in _blocks(list(models), BASIN_BLOCK):
        part = {k: models[k] for k in some}
        rows = _bases(all_rows, part, key)
        watched = None
        if valid is not None:
            watched = cut_lineage(_bases(binned(valid, edges, names, key, [key, F.col(label).cast("double").alias("y")]), part, key), "boost_valid")
        going, pending = list(part), {k: [] for k in part}
        for round_ in range(settings.rounds):
            g, h = _gradients(settings.loss, F.col("w"))
            state = _with_margin(rows, pending, key, settings.depth).where(F.col(key).isin(going) if len(going) < len(part) else F.lit(True))
            if settings.row_share < 1:
                state = state.where(_sampled(settings, key, round_))
            grown = grow(state.select(key, F.lit(0).alias("tree"), "bins", g.alias("g"), h.alias("h")), [(k, 0) for k in going],
                         settings, key, len(names), _features_of(settings, len(names), round_))
            for k in going:
                part[k].trees.append(grown[(k, 0)])
                pending[k].append(grown[(k, 0)])
            if (round_ + 1) % STRETCH == 0 or round_ + 1 == settings.rounds:
                if watched is not None:
                    for k, more in staged_loss(watched, pending, key, settings.depth, settings.loss).items():
                        if k in going:
                            part[k].loss += more
                    watched = cut_lineage(_with_margin(watched, pending, key, settings.depth), "boost_valid")
                    if settings.patience:
                        going = [k for k in going if not (part[k].loss and stop_at(part[k].loss, settings.patience)[1])]
                if round_ + 1 < settings.rounds and going:
                    rows = cut_lineage(_with_margin(rows, pending, key, settings.depth), "boost_rows")
                pending = {k: [] for k in part}
                if not going:
                    break
        for m in part.values():
            if settings.patience and m.loss:
                m.best = stop_at(m.loss, settings.patience)[0]
                m.trees = m.trees[:m.best]
    return Fitted(key, order, names, settings, models)


# ----------------------------------------------------------------- forest

#: distribution function of the Poisson law of mean 1, up to 6 copies of a row
_POISSON = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(7)]


def _copies(settings: Settings, key: str) -> Column:
    """How often a row is drawn for a tree: Poisson with mean 1, by a hash."""
    u = F.pmod(F.xxhash64(F.lit(settings.seed), "tree", key, "_order"), F.lit(1 << 30)) / float(1 << 30)
    n = F.lit(len(_POISSON))
    for k in range(len(_POISSON) - 1, -1, -1):
        n = F.when(u < _POISSON[k], k).otherwise(n)
    return n.cast("double")


def fit_forest(train: DataFrame, names: Sequence[str], label: str = "label", weight: str | None = None, settings: Settings = FOREST,
               key: str = "basin_id", order: str = "hour", per_node: int | None = None) -> Fitted:
    """Bagged trees for every basin (M1); with 0/1 labels a leaf's value is
    the weighted share of ones. Each node chooses among ``per_node`` random
    features (the square root of their number unless given)."""
    names = list(names)
    per_node = per_node or max(1, int(math.sqrt(len(names))))
    rows, _, models = _prepare(train, names, label, weight, settings, key, order)
    for some in _blocks(list(models), BASIN_BLOCK):
        for trees in _blocks(list(range(settings.rounds)), FOREST_BLOCK):
            drawn = (rows.where(F.col(key).isin(some)) if len(some) < len(models) else rows).withColumn(
                "tree", F.explode(F.array(*[F.lit(t) for t in trees])))
            drawn = drawn.withColumn("h", F.col("w") * _copies(settings, key)).where("h > 0")
            grown = grow(drawn.select(key, "tree", "bins", (-F.col("h") * F.col("y")).alias("g"), "h"),
                         [(k, t) for k in some for t in trees], settings, key, len(names), per_node=per_node)
            for k in some:
                models[k].trees += [grown[(k, t)] for t in trees]
    for m in models.values():
        m.base = 0.0
    return Fitted(key, order, names, replace(settings, loss="mean"), models, forest=True)


# ---------------------------------------------------------------- scoring

def predict(df: DataFrame, fitted: Fitted, out: str = "prediction") -> DataFrame:
    """``df`` with the prediction of its basin's model: a probability for the
    logistic loss and for forests, else the value; null without a model."""
    key, s = fitted.key, fitted.settings
    key_type = df.schema[key].dataType.simpleString()
    table = _driver_rows(df.sparkSession, [{key: k, "base": m.base, "edges": m.edges, "ts": [_walkable(t) for t in m.trees]}
                                           for k, m in fitted.models.items()],
                         f"`{key}`: {key_type}, base: double, edges: array<array<double>>, ts: array<{_TREE_TYPE}>")
    have = set(df.columns)
    values = F.array(*[F.col(f"`{n}`").cast("double") if n in have else F.lit(0.0) for n in fitted.names])
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    # the models as they are: one row a basin, like any model that Spark ML sends to its tasks
    met = df.select(row, F.col(key).alias("_k"), values.alias("_v")).join(F.broadcast(table.withColumnRenamed(key, "_m")), F.col("_k") == F.col("_m"), "left")
    met = met.withColumn("bins", F.expr("transform(_v, (x, f) -> CAST(greatest(size(filter(edges[f], e -> e < x)), 0) AS INT))"))
    total = F.expr(f"aggregate(ts, base, (m, t) -> m + t.v[{_WALK.format(depth=s.depth, t='t')}])")
    if fitted.forest:
        total = total / F.size("ts")
    elif s.loss == "logistic":
        total = 1 / (1 + F.exp(-total))
    return met.select("_row.*", total.alias(out))


def save(spark: SparkSession, fitted: Fitted, path: str, meta: dict | None = None) -> None:
    """Models as a table (a row a basin) and their settings as one JSON line; works on any Hadoop path."""
    rows = [(str(k), m.base, m.edges, [(t.feature, t.cut, t.value, t.gain) for t in m.trees]) for k, m in fitted.models.items()]
    spark.createDataFrame(rows, "key string, base double, edges array<array<double>>, "
                          "ts array<struct<f: array<int>, c: array<int>, v: array<double>, w: array<double>>>").write.mode("overwrite").parquet(f"{path}/models")
    text = json.dumps({"key": fitted.key, "order": fitted.order, "names": fitted.names, "forest": fitted.forest,
                       "settings": asdict(fitted.settings), "meta": meta or {}})
    spark.createDataFrame([(text,)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> tuple[Fitted, dict]:
    """What ``save`` wrote: the models and the caller's ``meta``; keys come
    back as whole numbers where they are written as such."""
    text = json.loads(spark.read.text(f"{path}/meta").first()[0])
    s = Settings(**text["settings"])
    models = {}
    for r in spark.read.parquet(f"{path}/models").collect():     # a row a basin
        k = int(r.key) if r.key.lstrip("-").isdigit() else r.key
        models[k] = Model(r.base, r.edges, [Tree(s.depth, t.f, t.c, t.v, t.w) for t in r.ts])
    return Fitted(text["key"], text["order"], text["names"], s, models, text["forest"]), text["meta"]


def gain_importance(spark: SparkSession, fitted: Fitted) -> DataFrame:
    """key, feature, importance (M7): the gain of a feature's splits, shares
    of the basin's total; mean gain of a split for boosted models, the sum of
    gains for forests. Ascending."""
    rows = []
    for k, m in fitted.models.items():
        total, count = dict.fromkeys(fitted.names, 0.0), dict.fromkeys(fitted.names, 0)
        for t in m.trees:
            for f, gain in zip(t.feature, t.gain):
                if f >= 0:
                    total[fitted.names[f]] += gain
                    count[fitted.names[f]] += 1
        share = {n: total[n] if fitted.forest or not count[n] else total[n] / count[n] for n in fitted.names}
        z = sum(share.values()) or 1.0
        rows += [(k, n, x / z) for n, x in share.items()]
    kind = {int: "bigint", str: "string"}[type(rows[0][0])] if rows else "bigint"
    return spark.createDataFrame(rows, f"`{fitted.key}` {kind}, feature string, importance double").orderBy(fitted.key, "importance", "feature")


def split_thresholds(fitted: Fitted, key_value, tree: int = 0) -> list[tuple[int, str, float, float]]:
    """(node, feature, threshold, gain) of a tree: values up to the threshold go left."""
    m = fitted.models[key_value]
    t = m.trees[tree]
    return [(k, fitted.names[f], m.edges[f][t.cut[k]], t.gain[k]) for k, f in enumerate(t.feature) if f >= 0]
