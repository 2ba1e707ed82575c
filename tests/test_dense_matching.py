"""Locations among many settlements: the best pair without making all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from floodlake.functions.text import name_score_fast
from floodlake.operators import match
from floodlake.operators.match import best_pair, geo_match, radius_pairs
from floodlake.plans.catalog import REGISTRY

LOC = "ims_id long, ims_name string, lat double, lon double"
ST = "settlement_id long, name_eng string, lat double, lon double"
PARTS = ["kfar", "Beit", "tel", "Nahal", "ein", "Ramat", "Giv'at", "אב"]


def by_all_pairs(loc, st_):
    """Best pair by scoring every pair within the radius."""
    p = radius_pairs(loc, st_).withColumn("score", name_score_fast(F.col("ims_name"), F.col("r_name_eng")))
    return {r.ims_id: (r.r_settlement_id, r.r_name_eng, round(r.distance_km, 2), r.score)
            for r in best_pair(p, "ims_id").collect() if r.ims_id is not None}


def town(n_names, n_settle, n_locs, spread, seed):
    rnd = random.Random(seed)
    names = [" ".join([rnd.choice(PARTS), "".join(rnd.choice("abdehilmnorst") for _ in range(rnd.randint(1, 7)))])
             for _ in range(n_names)] + [None, "", "BEIT tel"]

    def place():
        return round(31 + rnd.uniform(0, spread), 3), round(35 + rnd.uniform(0, spread), 3)
    settle = [(rnd.choice([None, *range(n_settle)]) if j % 50 == 0 else j, rnd.choice(names), *place()) for j in range(n_settle)]
    settle += [(3, "kfar x", None, 35.0), settle[5], settle[5]]
    locs = [(i // 2 if i % 9 == 0 else i, rnd.choice([rnd.choice(names), "zq" + rnd.choice(PARTS), "xxxxx"]), *place())
            for i in range(n_locs)]
    return locs + [(None, "tel", 31.0, 35.0), (5000, "tel", None, 35.0), (5001, "tel", 40.0, 35.0), locs[3]], settle


@pytest.mark.parametrize("n_names,n_settle,spread", [(12, 900, 0.05), (300, 300, 0.2)])
def test_passes_over_names_find_the_best_of_all_pairs(spark, monkeypatch, n_names, n_settle, spread):
    monkeypatch.setattr(match, "SCORE_PASSES", (75, 40, 0))
    locs, settle = town(n_names, n_settle, 80, spread, n_names)
    loc, st_ = spark.createDataFrame(locs, LOC), spark.createDataFrame(settle, ST)
    want = by_all_pairs(loc, st_)
    rows = geo_match(loc, st_, few_pairs=0).collect()
    assert len(rows) == len(locs)
    for r in rows:
        sid, name, d, s = want.get(r.ims_id, (None, None, None, 0))
        assert (r.matched_id, r.matched_name, r.distance_km, r.score) == (
            sid, name if name is not None else match.NO_MATCH, d, s), r


def largest_tables(monkeypatch):
    rows, cut = [], match.cut_lineage

    def counted(df, name="table"):
        table = cut(df, name)
        rows.append((table.count(), name))
        return table
    monkeypatch.setattr(match, "cut_lineage", counted)
    return rows


def test_pairs_of_a_dense_town_are_not_made(spark, monkeypatch):
    """200 locations with 4,000 settlements of 20 names around each: 800,000 pairs."""
    rnd = random.Random(5)
    settle = [(j, f"{PARTS[j % 5]} {'abcd'[j % 4]}", 31 + rnd.uniform(0, 0.03), 35 + rnd.uniform(0, 0.03)) for j in range(4000)]
    locs = [(i, f"{PARTS[i % 5]}{'abcd'[i % 4]}", 31 + rnd.uniform(0, 0.03), 35 + rnd.uniform(0, 0.03)) for i in range(200)]
    loc, st_ = spark.createDataFrame(locs, LOC), spark.createDataFrame(settle, ST)
    made = largest_tables(monkeypatch)
    got = {r.ims_id: (r.matched_id, r.matched_name, r.distance_km, r.score) for r in geo_match(loc, st_).collect()}
    assert max(made)[0] <= match.FEW_PAIRS, made
    assert got == by_all_pairs(loc, st_)


@pytest.mark.parametrize("query", ["geo_match", "mapping_clean", "forecast_match", "settlements_updated"])
def test_queries_on_settlements_of_one_place_make_no_pairs(spark, monkeypatch, tmp_path, query):
    """Keys that the views put at one place: 4,000 settlements, 200 locations."""
    key = F.col("id") * 26600 + 1
    spark.range(4000).select(key.alias("p_partkey"), F.concat_ws(" ", F.element_at(F.array(*map(F.lit, PARTS)), (F.col("id") % 8 + 1).cast("int")),
                             F.lit("blue")).alias("p_name")).write.parquet(str(tmp_path / "part.parquet"))
    spark.range(200).select(key.alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(500).select(
        (F.col("id") % 120).alias("o_custkey"), F.col("id").alias("o_orderkey"), F.lit("O").alias("o_orderstatus"),
        F.lit(5e4).alias("o_totalprice"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'").alias("o_orderdate"),
    ).write.parquet(str(tmp_path / "orders.parquet"))
    made = largest_tables(monkeypatch)
    rows = REGISTRY[query](spark, str(tmp_path)).collect()
    assert max(made)[0] <= match.FEW_PAIRS, made
    assert len(rows) == {"geo_match": 200, "mapping_clean": 200, "forecast_match": 1, "settlements_updated": 4000}[query]
    if query == "geo_match":
        assert all(r.matched_id <= 7 * 26600 + 1 and r.score > 80 for r in rows)
