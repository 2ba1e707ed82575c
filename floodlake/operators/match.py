"""Forecast locations -> settlements: radius join plus name score.

Plan: settlements get one (band, cell) bucket, locations probe at most 9;
the equi-join on the bucket replaces the nested loop over all pairs, the
haversine filter runs before the (costlier) name score, a bound on the score
from letter counts leaves out pairs that cannot win, and the best
candidate per location is a partial aggregate (max over a struct), so a
location with many candidates never sorts them in one task. Locations
without a candidate (or without coordinates) are kept as NO MATCH.

Where settlements lie dense the pairs grow with the square of the input, so
they are not made: the names of a bucket are compared before its points, in
passes from the highest scores down. A location with a settlement of a pass
within the radius is done, as all names of later passes score less; of the
names of a pass only the points near the location are met, by radii that
start where a few settlements of its best name are expected.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km, with_home_bucket, with_probe_buckets
from ..functions.text import name_score, name_score_fast
from ..session import cut_lineage

# The search radius and the label of an unmatched location.
MATCH_RADIUS_KM = 5.0
NO_MATCH = "NO MATCH FOUND"

#: the letters that are counted one by one
LETTERS = "abcdefghijklmnopqrstuvwxyz"

#: up to so many pairs of a location and a settlement of its buckets are met one by one
FEW_PAIRS = 500_000
#: the least score of each pass over the names of the buckets; the last takes all
SCORE_PASSES = (90, 75, 60, 40, 0)
#: how many settlements of its best name a location should meet in the first radius
NEAR = 6


def radius_pairs(left: DataFrame, right: DataFrame, radius_km: float = MATCH_RADIUS_KM,
                 left_cols: tuple[str, str] = ("lat", "lon"),
                 right_cols: tuple[str, str] = ("lat", "lon"), same: Sequence[str] = ()) -> DataFrame:
    """All (left, right) pairs within ``radius_km``, with ``distance_km``.
    Rows with a NULL coordinate never pair. Columns of ``right`` are
    prefixed ``r_``, but for those of ``same``, which must be equal too."""
    la, lo = left_cols
    ra, ro = right_cols
    probes = with_probe_buckets(left.filter(F.col(la).isNotNull() & F.col(lo).isNotNull()), la, lo, radius_km)
    r = right.filter(F.col(ra).isNotNull() & F.col(ro).isNotNull())
    r = with_home_bucket(r.select(*[F.col(c).alias(c if c in same else f"r_{c}") for c in r.columns]),
                         f"r_{ra}", f"r_{ro}", radius_km)
    pairs = probes.join(r, ["_bk", *same]).drop("_bk")
    d = haversine_km(F.col(la), F.col(lo), F.col(f"r_{ra}"), F.col(f"r_{ro}"))
    return pairs.withColumn("distance_km", d).filter(F.col("distance_km") <= radius_km)


def score_bound(name: Column, other: Column) -> Column:
    """An upper bound of the LCS length of two lists of letter counts: what
    they have in common, letter by letter."""
    return F.aggregate(F.zip_with(name, other, lambda a, b: F.least(a, b)), F.lit(0), lambda a, n: a + n)


def letter_counts(name: Column) -> Column:
    """How often the lower-cased name has each of ``LETTERS``, and all other
    characters together, which can only make the bound larger."""
    low = F.lower(F.coalesce(name, F.lit("")))
    counts = [F.length(low) - F.length(F.replace(low, F.lit(c))) for c in LETTERS]
    return F.array(*counts, F.length(F.translate(low, LETTERS, "")))


def _ranked(score: Column) -> Column:
    """The order of candidates: score, nearest, smallest settlement id, name."""
    return F.struct(score.alias("score"), (-F.col("distance_km")).alias("neg_d"), (-F.col("r_settlement_id")).alias("neg_id"),
                    F.col("r_name_eng").alias("sname"))


def candidates(locations: DataFrame, settlements: DataFrame, radius_km: float = MATCH_RADIUS_KM) -> DataFrame:
    """All pairs within the radius with ``bound``, the largest score their
    names can have. Letters are counted once a name, before the join."""
    loc = locations.select("ims_id", "ims_name", "lat", "lon", letter_counts(F.col("ims_name")).alias("_l"))
    st = settlements.select("settlement_id", "name_eng", "lat", "lon", letter_counts(F.col("name_eng")).alias("l"))
    total = F.length(F.lower("ims_name")) + F.length(F.lower("r_name_eng"))
    raw = F.bround(F.lit(200.0) * score_bound(F.col("_l"), F.col("r_l")) / total, 0).cast("int")
    return (radius_pairs(loc, st, radius_km)
            .select("ims_id", "ims_name", "r_settlement_id", "r_name_eng", "distance_km",
                    F.when(total > 0, raw).otherwise(0).alias("bound")))


def open_candidates(pairs: DataFrame, score: Callable[[Column, Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Of every location the pair of largest bound, scored, and the other
    pairs that may still be better than it: those whose bound, distance and
    id rank before its score, distance and id. What is left out cannot win,
    so the best pair is the same as with all pairs scored."""
    first = (pairs.groupBy("ims_id", "ims_name")
             .agg(F.max_by(F.struct("r_settlement_id", "r_name_eng", "distance_km"), _ranked(F.col("bound"))).alias("b"))
             .select("ims_id", "ims_name", "b.*"))
    first = cut_lineage(first.withColumn("score", score(F.col("ims_name"), F.col("r_name_eng"))), "match_first")
    beaten = first.select(F.col("ims_id").alias("_i"), F.col("ims_name").alias("_n"), _ranked(F.col("score")).alias("_top"))
    same = (F.col("ims_id") == F.col("_i")) & F.col("ims_name").eqNullSafe(F.col("_n"))
    rest = pairs.join(beaten, same & (_ranked(F.col("bound")) > F.col("_top")), "left_semi").select(*first.columns[:-1])
    return first, rest


def marked(names: DataFrame, name: str) -> DataFrame:
    """Adds the letter counts of a lower-cased name in a form that two names
    are compared by in a few operations: ``<name>_bits`` marks the first two
    of every letter, ``<name>_more`` is how many letters are beyond those,
    ``<name>_len`` the length."""
    bits = ("aggregate(transform(_c, (n, i) -> shiftleft(CASE WHEN n > 1 THEN 3L WHEN n > 0 THEN 1L ELSE 0L END, 2 * i)), "
            "0L, (a, b) -> a | b)")
    more = "aggregate(_c, 0, (a, n) -> a + greatest(n - 2, 0))"
    return names.select("*", letter_counts(F.col(name)).alias("_c")).select(
        *names.columns, F.expr(bits).alias(f"{name}_bits"), F.expr(more).alias(f"{name}_more"), F.length(name).alias(f"{name}_len"))


def bucket_pairs(asked: DataFrame, homes: DataFrame, radius_km: float) -> int:
    """How many pairs of a location and a settlement share a bucket;
    ``homes``: ``n`` settlements of every ``_bk``."""
    probes = with_probe_buckets(asked, "lat", "lon", radius_km).groupBy("_bk").agg(F.count(F.lit(1)).alias("p"))
    return probes.join(homes, "_bk").agg(F.sum(F.col("p") * F.col("n"))).first()[0] or 0


def best_pair(scored: DataFrame, *keys: str) -> DataFrame:
    """Per key the first of the scored pairs by ``_ranked``."""
    best = scored.groupBy(*keys).agg(F.max(F.struct(
        _ranked(F.col("score")).alias("rank"), F.col("r_settlement_id").alias("sid"), F.col("distance_km").alias("d"))).alias("b"))
    return best.select(*keys, F.col("b.rank.score").alias("score"), F.col("b.d").alias("distance_km"),
                       F.col("b.sid").alias("r_settlement_id"), F.col("b.rank.sname").alias("r_name_eng"))


def names_of_pass(asked: DataFrame, shelf: DataFrame, least: int, radius_km: float,
                  score: Callable[[Column, Column], Column]) -> DataFrame:
    """Per location (``_q``) the names ``k`` in its buckets that score ``least``
    or more, how many settlements have them there (``n``), and ``top``, the
    highest score among them. ``shelf``: the names of every bucket, marked."""
    probes = with_probe_buckets(asked, "lat", "lon", radius_km)
    sought = marked(probes.select("_bk", "l").distinct(), "l")
    common = (F.bit_count(F.col("l_bits").bitwiseAND(F.col("k_bits"))) + F.least("l_more", "k_more")).cast("long")
    # a score of ``least`` has 200 * LCS / total >= least - 0.5, as it is rounded
    may = sought.join(shelf, "_bk").filter(F.lit(400) * common >= F.lit(2 * least - 1) * (F.col("l_len") + F.col("k_len")))
    may = cut_lineage(may.select("_bk", "l", "k", "n"), "match_names")
    scores = may.select("l", "k").distinct().withColumn("score", score(F.col("l"), F.col("k"))).filter(F.col("score") >= least)
    named = probes.join(may.join(scores, ["l", "k"]), ["_bk", "l"]).groupBy(
        "_q", "ims_id", "lat", "lon", "k", "score").agg(F.sum("n").alias("n"))
    return named.withColumn("top", F.max("score").over(Window.partitionBy("_q")))


def best_of_pass(named: DataFrame, points: DataFrame, radius_km: float) -> list[DataFrame]:
    """The best pair of every location that has a settlement of its names of
    this pass (``named``) within the radius. A location that meets its top
    name within a smaller radius is done: no other pair can be better than
    the nearest of those. The others go on to larger radii, at the full one
    with all their names."""
    top = F.col("score") == F.col("top")
    met = named.filter(top).agg(F.sum("n") / F.countDistinct("_q")).first()[0]
    if met is None:
        return []
    found = []
    # the buckets of a location have 9 * radius^2 of area, a circle pi * r^2
    r = radius_km * math.sqrt(9 * NEAR / (math.pi * met))
    while r < radius_km / 2:
        near = radius_pairs(named.filter(top), points, r, same=("k",))
        # a little less than the radius of the buckets, so rounding at its edge cannot hide a nearer one
        found.append(cut_lineage(best_pair(near.filter(F.col("distance_km") <= 0.999 * r), "_q", "ims_id"), "match_found"))
        named = cut_lineage(named.join(found[-1].select("_q"), "_q", "left_anti"), "match_named")
        r *= 4
    found.append(cut_lineage(best_pair(radius_pairs(named, points, radius_km, same=("k",)), "_q", "ims_id"), "match_found"))
    return found


def dense_matches(locations: DataFrame, settlements: DataFrame, radius_km: float, homes: DataFrame, few_pairs: int,
                  score: Callable[[Column, Column], Column]) -> tuple[list[DataFrame], DataFrame | None, DataFrame]:
    """Best pairs by passes over the names, until the pairs left are few:
    those found, the locations still open (None if no pass is left) and the
    settlements, where those of one name and place are one (smallest id)."""
    lower = {"l": "ims_name", "k": "name_eng"}
    l, k = (F.lower(F.coalesce(F.col(c), F.lit(""))).alias(n) for n, c in lower.items())
    asked = cut_lineage(locations.select(F.monotonically_increasing_id().alias("_q"), "ims_id", "ims_name", "lat", "lon", l),
                        "match_asked")
    points = cut_lineage(settlements.groupBy("lat", "lon", "name_eng").agg(F.min("settlement_id").alias("settlement_id"))
                         .select("settlement_id", "name_eng", "lat", "lon", k), "match_points")
    shelf = (with_home_bucket(points, "lat", "lon", radius_km).groupBy("_bk", "k").agg(F.count(F.lit(1)).alias("n")))
    shelf = cut_lineage(marked(shelf, "k"), "match_shelf")
    found = []
    for least in SCORE_PASSES:
        named = cut_lineage(names_of_pass(asked, shelf, least, radius_km, score), "match_named")
        done = best_of_pass(named, points, radius_km)
        if not done:
            continue
        found += done
        for hits in done:
            asked = asked.join(hits.select("_q"), "_q", "left_anti")
        asked = cut_lineage(asked, "match_asked")
        if bucket_pairs(asked, homes, radius_km) <= few_pairs:
            return found, asked, points
    return found, None, points


def geo_match(locations: DataFrame, settlements: DataFrame, radius_km: float = MATCH_RADIUS_KM,
              kernel: str = "arrow", few_pairs: int = FEW_PAIRS) -> DataFrame:
    """Best settlement per location: highest name score, then nearest, then
    smallest settlement id. ``locations``: ims_id, ims_name, lat, lon;
    ``settlements``: settlement_id, name_eng, lat, lon. ``kernel='jvm'``
    scores with the higher-order-function DP instead of the Arrow kernel.

    The pairs within the radius grow with the density of the settlements: more
    than ``few_pairs`` are not made, names are compared first (``dense_matches``);
    of the others, only those that can still be the best by the bound on their
    letters are scored."""
    score = name_score if kernel == "jvm" else name_score_fast
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    loc, st = locations.filter(placed & F.col("ims_id").isNotNull()), settlements.filter(placed)
    homes = with_home_bucket(st.select("lat", "lon"), "lat", "lon", radius_km).groupBy("_bk").agg(F.count(F.lit(1)).alias("n"))
    found, asked = [], loc
    if bucket_pairs(loc, homes, radius_km) > few_pairs:
        found, asked, st = dense_matches(loc, st, radius_km, homes, few_pairs, score)
    scored = [f.drop("_q") for f in found]
    if asked is not None:
        pairs = cut_lineage(candidates(asked, st, radius_km), "match_pairs")
        first, rest = open_candidates(pairs, score)
        scored += [p.select("ims_id", "score", "distance_km", "r_settlement_id", "r_name_eng") for p in (
            first, rest.withColumn("score", score(F.col("ims_name"), F.col("r_name_eng"))))]
    best = best_pair(functools.reduce(DataFrame.unionByName, scored), "ims_id").withColumnRenamed("r_name_eng", "sname")
    return (locations.select("ims_id", "ims_name").join(best, "ims_id", "left")
            .select("ims_id", "ims_name",
                    F.col("r_settlement_id").cast("double").alias("matched_id"),
                    F.coalesce(F.col("sname"), F.lit(NO_MATCH)).alias("matched_name"),
                    F.round(F.col("distance_km"), 2).alias("distance_km"),
                    F.coalesce(F.col("score"), F.lit(0)).alias("score")))
