"""Trees of all basins at once against plain versions."""

import datetime as dt
import math

import numpy as np
import pytest

from floodlake.operators import boost

NAMES = ["a", "b", "c"]


def data(n=160, basins=(0, 1), seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for b in basins:
        a, c = rng.normal(size=n), rng.integers(0, 5, n).astype(float)
        bb = rng.gamma(1.0, 2.0, n)
        y = ((a > 0.3) ^ (c > 2)) if b == 0 else (bb > 2)
        for k in range(n):
            out.append((b, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), float(a[k]), float(bb[k]), float(c[k]), int(y[k]), float(a[k] * 2 + c[k])))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "basin_id int, hour timestamp_ntz, a double, b double, c double, label int, flow double").repartition(4)


def plain_edges(x, bins):
    s = sorted(x)
    return sorted({s[k * (len(s) - 1) // bins] for k in range(1, bins)})


def plain_tree(bins, g, h, depth, l2, min_weight, rate, edges):
    """(feature, cut, value, gain) heaps by trying every split of every node."""
    f, c, v, w = ([x] * (2 << depth) for x in (-1, 0, 0.0, 0.0))
    at = np.ones(len(g), int)
    v[1] = -rate * g.sum() / (h.sum() + l2)
    for level in range(depth):
        for node in range(1 << level, 2 << level):
            m = at == node
            if not m.any():
                continue
            best = (0, 0, 0)
            for k in range(bins.shape[1]):
                for cut in range(len(edges[k])):
                    left = m & (bins[:, k] <= cut)
                    if left.sum() in (0, m.sum()) or not (bins[m, k] == cut).any():
                        continue
                    gl, hl, gr, hr = g[left].sum(), h[left].sum(), g[m & ~left].sum(), h[m & ~left].sum()
                    if hl < min_weight or hr < min_weight:
                        continue
                    gain = round(gl ** 2 / (hl + l2) + gr ** 2 / (hr + l2) - g[m].sum() ** 2 / (h[m].sum() + l2), 9)
                    best = max(best, (gain, -k, -cut))
            if best[0] > 1e-9:
                w[node], k, cut = best[0], -best[1], -best[2]
                f[node], c[node] = k, cut
                left = m & (bins[:, k] <= cut)
                v[2 * node] = -rate * g[left].sum() / (h[left].sum() + l2)
                v[2 * node + 1] = -rate * g[m & ~left].sum() / (h[m & ~left].sum() + l2)
                at[m & ~left] = 2 * node + 1
                at[left] = 2 * node
    return f, c, v, w, at


def plain_boost(rows, label, s):
    """basin -> (trees, margins) with the whole data in memory."""
    out = {}
    for b in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == b]
        x = np.array([r[2:5] for r in mine])
        y = np.array([r[label] for r in mine], float)
        edges = [plain_edges(x[:, k], s.bins) for k in range(3)]
        bins = np.array([[sum(e < v for e in edges[k]) for k, v in enumerate(r)] for r in x])
        margin = np.full(len(y), y.mean() if s.loss == "squared" else 0.0)
        trees = []
        for _ in range(s.rounds):
            p = margin if s.loss == "squared" else 1 / (1 + np.exp(-margin))
            h = np.ones(len(y)) if s.loss == "squared" else p * (1 - p)
            t = plain_tree(bins, p - y, h, s.depth, s.l2, s.min_weight, s.rate, edges)
            trees.append(t)
            margin = margin + np.array(t[2])[t[4]]
        out[b] = trees, margin, edges
    return out


@pytest.mark.parametrize("loss,label", [("logistic", 5), ("squared", 6)])
def test_boosting_equals_brute_force(spark, loss, label, monkeypatch):
    monkeypatch.setattr(boost, "STRETCH", 2)     # margins are written between rounds
    s = boost.Settings(rounds=3, depth=3, rate=0.3, row_share=1, feature_share=1, bins=9, loss=loss, min_weight=0.5)
    rows = data()
    df = frame(spark, rows)
    fitted = boost.fit_boosted(df, NAMES, "label" if loss == "logistic" else "flow", settings=s)
    want = plain_boost(rows, label, s)
    assert set(fitted.models) == set(want)
    for b, (trees, _, edges) in want.items():
        assert np.allclose(np.concatenate(fitted.models[b].edges), np.concatenate(edges))
        for got, t in zip(fitted.models[b].trees, trees):
            assert got.feature == t[0] and got.cut == t[1]
            assert np.allclose(got.value, t[2]) and np.allclose(got.gain, t[3], atol=1e-6)
    scored = boost.predict(df, fitted).orderBy("basin_id", "hour").collect()
    margins = np.concatenate([want[b][1] for b in sorted(want)])
    assert np.allclose([r.prediction for r in scored], margins if loss == "squared" else 1 / (1 + np.exp(-margins)))


def test_the_number_of_jobs_does_not_depend_on_the_basins(spark):
    s = boost.Settings(rounds=2, depth=2, row_share=1, feature_share=0.5, bins=8)
    status = spark.sparkContext.statusTracker()
    jobs = []
    for basins in ((0,), tuple(range(30))):
        df = frame(spark, data(40, basins))
        spark.sparkContext.setJobGroup(f"boost{len(basins)}", "fit")
        fitted = boost.fit_boosted(df, NAMES, settings=s)
        jobs.append(len(status.getJobIdsForGroup(f"boost{len(basins)}")))
        assert len(fitted.models) == len(basins) and all(len(m.trees) == 2 for m in fitted.models.values())
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # adaptive execution may add a job for a stage or two, not one a basin
    assert jobs[1] <= jobs[0] + 12


def test_patience_keeps_the_best_round(spark, monkeypatch):
    monkeypatch.setattr(boost, "STRETCH", 3)
    rng = np.random.default_rng(1)
    rows = [(*r[:6], float(rng.normal())) for r in data(60)]     # noise: more rounds soon fit it worse
    train, valid = [r for k, r in enumerate(rows) if k % 2], [r for k, r in enumerate(rows) if not k % 2]
    s = boost.Settings(rounds=12, depth=2, rate=0.8, row_share=1, feature_share=1, bins=8, loss="squared", patience=3)
    fitted = boost.fit_boosted(frame(spark, train), NAMES, "flow", valid=frame(spark, valid), settings=s)
    for b, m in fitted.models.items():
        assert len(m.loss) >= 3 and len(m.trees) == m.best == boost.stop_at(m.loss, 3)[0]
        # the curve is the error of every prefix of the trees
        y = np.array([r[6] for r in valid if r[0] == b])
        part = boost.Fitted(fitted.key, fitted.order, fitted.names, s, {b: boost.Model(m.base, m.edges, m.trees)})
        got = boost.predict(frame(spark, [r for r in valid if r[0] == b]), part).orderBy("hour").collect()
        assert math.isclose(m.loss[m.best - 1], math.sqrt(np.mean((np.array([r.prediction for r in got]) - y) ** 2)), rel_tol=1e-9)


def test_stopping_rule():
    assert boost.stop_at([5, 4, 3, 4, 4, 4, 1], 3) == (3, True)
    assert boost.stop_at([5, 4, 3, 4, 4], 3) == (3, False)
    assert boost.stop_at([5, 4, 4, 4, 4], 3) == (2, True)
    assert boost.stop_at([1.0], 50) == (1, False)


def test_forest_learns_and_shares_sum_to_one(spark):
    rows = data(200)
    df = frame(spark, rows)
    fitted = boost.fit_forest(df, NAMES, settings=boost.replace(boost.FOREST, rounds=6, depth=4, bins=16), per_node=2)
    assert all(len(m.trees) == 6 for m in fitted.models.values())
    got = boost.predict(df, fitted, "p").collect()
    assert all(0 <= r.p <= 1 for r in got)
    assert np.mean([(r.p >= 0.5) == (r.label == 1) for r in got]) > 0.9
    shares = boost.gain_importance(spark, fitted).collect()
    for b in (0, 1):
        assert math.isclose(sum(r.importance for r in shares if r.basin_id == b), 1)
    assert max((r.importance, r.feature) for r in shares if r.basin_id == 1)[1] == "b"


def test_null_features_and_unknown_basins(spark):
    s = boost.Settings(rounds=1, depth=1, row_share=1, feature_share=1, bins=4)
    rows = [(0, dt.datetime(2024, 1, 1, k % 24), float(k), None, 1.0, int(k > 5), 0.0) for k in range(12)]
    fitted = boost.fit_boosted(frame(spark, rows), NAMES, settings=s)
    got = boost.predict(frame(spark, [*rows[:1], (7, *rows[0][1:])]), fitted).collect()
    assert {r.basin_id: r.prediction is None for r in got} == {0: False, 7: True}
