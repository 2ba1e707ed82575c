"""Plans that fit all basins together."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_longseries import merged

from floodlake.operators import boost, features
from floodlake.plans import models

SMALL = boost.Settings(rounds=2, depth=2, row_share=0.8, feature_share=0.5, bins=8)


@pytest.fixture(scope="module")
def clean(spark):
    from floodlake.session import cut_lineage
    return cut_lineage(features.clean_features(merged(spark)))


def test_early_warning_of_all_basins(spark, clean, tmp_path):
    got = models.warn_early(clean, {0: 3.0, 1: 6.0}, "2023-11-25 00:00:00", horizon=2, settings=SMALL)
    scored = got["scored"].collect()
    assert all(r.alert == int(r.flood_probability > 0.3) and 0 < r.flood_probability < 1 for r in scored)
    facts = {r.basin_id: r for r in got["facts"].collect()}
    assert len(scored) == sum(r.n_test for r in facts.values())
    assert facts[0].train_floods > facts[1].train_floods       # each basin's own level
    for r in facts.values():
        assert math.isclose(r.scale_pos_weight, (r.n_train - r.train_floods) / max(r.train_floods, 1))
    assert got["confusion"].agg(F.sum("n")).first()[0] == len(scored) and got["auc"].count() == 2
    boost.save(spark, got["fitted"], str(tmp_path / "bundle"), {"horizon_hours": 2})
    back, meta = boost.load(spark, str(tmp_path / "bundle"))
    assert meta == {"horizon_hours": 2}
    rows = clean.where("hour > timestamp_ntz'2023-11-25 00:00:00'")
    again = boost.predict(rows.drop("Rolling_Rain_24h"), got["fitted"], "p").count()    # a missing feature counts as 0
    assert again == len(scored)
    p = {(r.basin_id, r.hour): r.p for r in boost.predict(rows, back, "p").collect()}
    assert np.allclose([p[(r.basin_id, r.hour)] for r in scored], [r.flood_probability for r in scored])


def test_flow_regressor_stops_early_and_reports(spark, clean):
    s = boost.Settings(rounds=6, depth=2, rate=0.6, row_share=1, feature_share=1, bins=8, loss="squared", patience=1)
    got = models.regress_flow(clean, 5.0, "2023-11-25 00:00:00", settings=s)
    rows = got["predicted"].collect()
    for b, m in got["fitted"].models.items():
        assert len(m.trees) == boost.stop_at(m.loss, 1)[0]
        error = [r.predicted - r.actual for r in rows if r.basin_id == b]
        assert math.isclose(math.sqrt(np.mean(np.square(error))), m.loss[m.best - 1], rel_tol=1e-9)
    assert got["metrics"].count() == 2
    assert got["flood"].count() == 2 and got["predicted"].where(F.col("predicted").isNull()).count() == 0
