"""Every registered query runs on the smallest tables, and every one with
an oracle returns the oracle's rows (DuckDB on the same parquet files)."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from small_tables import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
#: fits of many rounds; the same plans are tested with small settings in test_models_together.py and test_streaming_and_models.py
SLOW = {"flood_model_rf", "feature_importance", "flow_model_gbt", "flow_model_patience"}
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")   # no pair-of-everything joins


def assert_no_cartesian(df, name):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(op in plan for op in FORBIDDEN), name


def norm(v):
    import pandas as pd
    if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return str(v).replace("T", " ")
    if hasattr(v, "item"):
        return v.item()
    return v


def canon(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(rows, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "Soil_Moisture_EWM" in df.columns


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql())))
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    got = df.toPandas()
    assert_no_cartesian(df, name)
    want = duck.execute(entry.oracle_sql()[name]).df()
    c1, r1 = canon(got)
    c2, r2 = canon(want)
    assert c1 == c2
    assert len(r1) == len(r2)
    for a, b in zip(r1, r2):
        for x, y in zip(a, b):
            if isinstance(x, float) and isinstance(y, (float, int)):
                assert math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-6), (name, a, b)
            else:
                assert x == y or str(x) == str(y), (name, a, b)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - SLOW))
def test_rows_only_queries_run(spark, name):
    df = entry.queries()[name](spark, SF_SMALL)
    df.collect()
    assert_no_cartesian(df, name)
