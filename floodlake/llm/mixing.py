"""Mixing sources to target weights by temperature.

The token share p of every source is raised to an exponent a (the inverse
temperature) and normalised: w = p^a / sum p^a. Flattening (a < 1) raises the
entropy of the mix and repeats small sources more often than large ones. The
exponent is the largest one, at most 1, that reaches the target entropy (a
part of the logarithm of the number of sources), but no smaller than what the
repetition limit allows: no source may be passed over more than
``max_repeats`` times as often as the least repeated one. Both borders are
found by bisection over aggregates of the table of sources.

Budgets follow: with ``total_tokens`` set, source s gets w * total; without,
the total is the smallest one that passes once over every source, so nothing
is dropped. A budget is realised as passes over the source: whole passes, and
a last one that is cut at the budget. Every pass is a permutation of its own:
rows are ordered by a 40-bit hash of (seed, pass, id, hash of the text), whose
leading digits are the blocks. The cut is found by descending through the digits, one
aggregate over (source, digit) each, so that no task orders a whole source.
In the output, ``block`` deals all passes of all sources over ``blocks``
equal blocks of the mixed stream, each with the target weights.

Defined cases: a null source is a source of its own; rows without a word have
no tokens, weigh nothing and come once in every pass; a source without any
token gets weight 0 and one pass; rows that share an id, or have none, are
told apart by their texts, so a budget can be cut between them; rows equal in
id and text are copies of one row, share its place and stay or go together
(exact deduplication comes first); an empty table gives an empty result; all
columns of the input come back unchanged, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, wrap, words_of

#: digits of the order key, and how many there are: 4 * 10 bits
DIGIT, DIGITS = 10, 4
KEY_BITS = DIGIT * DIGITS
#: bisection levels per job, and jobs
LEVELS, ROUNDS = 6, 6


def order_key(seed: int, pass_no: Column, ident: Column, body: Column) -> Column:
    """The place of a row in one pass: 40 bits. ``body``: the hash of its text."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), pass_no.cast("long"), ident, body), 64 - KEY_BITS)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def source_shares(docs: DataFrame, source: Column, tokens: Column) -> DataFrame:
    """source, tokens, p: one row per source."""
    by = docs.groupBy(source.alias("source")).agg(F.sum(tokens).alias("tokens"), F.count("*").alias("rows"))
    total = by.agg(F.sum("tokens")).first()[0] or 0
    return by.withColumn("p", F.col("tokens") / F.lit(float(total or 1)))


def _probe(shares: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float]]:
    """For every exponent: entropy of the weights, and the highest number of
    passes of a source by the lowest. One job for all of them."""
    a = F.col("a")
    rows = (shares.where("tokens > 0").withColumn("a", F.explode(F.array(*[F.lit(float(x)) for x in exponents])))
            .withColumn("u", F.pow("p", a))
            .groupBy("a").agg(F.sum("u").alias("z"), F.sum(F.col("u") * F.log("u")).alias("ulogu"),
                              F.max(F.col("u") / F.col("p")).alias("most"), F.min(F.col("u") / F.col("p")).alias("least"))
            .select("a", (F.log("z") - F.col("ulogu") / F.col("z")).alias("entropy"),
                    (F.col("most") / F.col("least")).alias("spread")).collect())
    return {r["a"]: (r["entropy"], r["spread"]) for r in rows}


def _bisect(shares: DataFrame, holds) -> float:
    """The largest exponent in [0, 1] at which ``holds(entropy, spread)``,
    given that it holds below and fails above; 0 if it holds nowhere."""
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        n = 1 << LEVELS
        grid = [low + (high - low) * k / n for k in range(n + 1)]
        seen = _probe(shares, grid)
        while len(grid) > 2:
            mid = len(grid) // 2
            grid = grid[mid:] if holds(*seen[grid[mid]]) else grid[:mid + 1]
        if holds(*seen[grid[1]]):
            return grid[1]
        low, high = grid
    return low


def temperature(shares: DataFrame, entropy_part: float, max_repeats: float) -> float:
    """The exponent for the target entropy within the repetition limit."""
    n = shares.where("tokens > 0").count()
    if n < 2:
        return 1.0
    goal = entropy_part * math.log(n)
    for_entropy = _bisect(shares, lambda entropy, spread: entropy >= goal - 1e-12)
    # the spread falls with the exponent: the smallest allowed one lies just above the largest that breaks the limit
    limit = math.log(max_repeats) if max_repeats >= 1 else 0.0
    at_zero = math.log(_probe(shares, [0.0])[0.0][1])
    least = 0.0 if at_zero <= limit else _bisect(shares, lambda entropy, spread: math.log(spread) > limit)
    return max(for_entropy, least)


def mix(docs: DataFrame, ident: str = "doc_id", source: str = "source", text: str = "text", entropy_part: float = 0.98,
        max_repeats: float = 2.0, total_tokens: int | None = None, blocks: int = 64, seed: int = 17) -> DataFrame:
    """Rows of the mixed stream: ``row`` (all columns of the input), ``source``,
    ``weight``, ``n_tokens``, ``pass``, ``order_key`` (place in the pass) and ``block``."""
    rows = wrap(docs).select("row", F.col(f"row.`{ident}`").alias("id"), F.col(f"row.`{source}`").alias("source"),
                             text_hash(F.col(f"row.`{text}`")).alias("body"),
                             F.size(words_of(F.col(f"row.`{text}`"))).cast("long").alias("n_tokens"))
    slim = cut_lineage(rows.select("id", "body", "source", "n_tokens"), "mix_rows")
    shares = cut_lineage(source_shares(slim, F.col("source"), F.col("n_tokens")), "mix_sources")
    a = temperature(shares, entropy_part, max_repeats)
    weight = F.when(F.col("tokens") > 0, F.pow("p", F.lit(a))).otherwise(0.0)
    z, least = shares.agg(F.sum(weight), F.min(F.when(F.col("tokens") > 0, weight / F.col("tokens")))).first()
    shares = shares.withColumn("weight", weight / F.lit(float(z or 1.0)))
    total = float(total_tokens) if total_tokens is not None else (z or 1.0) / (least or 1.0)
    # passes: whole ones, and the tokens of the last one; a hair above a whole number is that number
    ratio = F.round(F.col("weight") * F.lit(total) / F.col("tokens"), 9)
    plan = shares.select(
        "source", "weight", "tokens",
        F.when(F.col("tokens") > 0, F.floor(ratio)).otherwise(1).cast("long").alias("whole"),
        F.when(F.col("tokens") > 0, F.floor(F.col("tokens") * (ratio - F.floor(ratio)))).otherwise(0)
         .cast("long").alias("rest"))
    plan = cut_lineage(plan.join(_cuts(slim, plan, seed), F.col("source").eqNullSafe(F.col("cut_source")), "left")
                       .drop("cut_source"), "mix_plan")
    # the small plan meets each row by its source; null sources as well
    out = (rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
           .select("row", "id", "body", F.col("r.source").alias("source"), "weight", "n_tokens", "whole", "rest", "tokens",
                   "cut", F.col("whole").alias("last")))
    in_rest = (F.col("rest") > 0) & (order_key(seed, F.col("last"), F.col("id"), F.col("body")) < F.col("cut"))
    passes = F.col("whole") + F.when(in_rest, 1).otherwise(0)
    out = out.where(passes > 0).withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), passes - 1)))
    key = order_key(seed, F.col("pass"), F.col("id"), F.col("body"))
    span = F.col("whole") + F.when(F.col("tokens") > 0, F.col("rest") / F.col("tokens")).otherwise(0.0)
    return (out.withColumn("order_key", key)
            .withColumn("block", F.least(F.floor((F.col("pass") + F.col("order_key") / float(1 << KEY_BITS)) / span * blocks),
                                         F.lit(blocks - 1)).cast("int"))
            .select("row", "source", "weight", "n_tokens", "pass", "order_key", "block"))


def _cuts(slim: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """cut_source, cut: keys below ``cut`` fill the tokens of the last pass.
    One digit at a time: sum the tokens of every digit below the prefix found
    so far, and go down into the digit where the running sum passes the
    budget. Rows of that last, 40-bit key are left out."""
    open_ = plan.where("rest > 0").select(F.col("source").alias("cut_source"), F.col("whole").alias("last"),
                                          F.col("rest").alias("left"), F.lit(0).cast("long").alias("prefix"))
    keyed = (slim.join(open_, F.col("source").eqNullSafe(F.col("cut_source")))
             .select("cut_source", order_key(seed, F.col("last"), F.col("id"), F.col("body")).alias("key"), "n_tokens"))
    keyed = cut_lineage(keyed, "mix_keys")
    for level in range(DIGITS):
        shift = KEY_BITS - DIGIT * (level + 1)
        at = open_.select(F.col("cut_source").alias("s"), "prefix", "left", "last")
        digit = F.shiftright("key", shift)
        sums = (keyed.join(at, F.col("cut_source").eqNullSafe(F.col("s")))
                .where(F.shiftright("key", shift + DIGIT) == F.col("prefix"))
                .groupBy("cut_source", "last", "left", "prefix", digit.alias("digit")).agg(F.sum("n_tokens").alias("n")))
        # at most 1,024 digits a source: running sums in one small array
        steps = sums.groupBy("cut_source", "last", "left", "prefix").agg(
            F.array_sort(F.collect_list(F.struct("digit", "n"))).alias("d"))
        walk = F.aggregate(
            "d", F.struct(F.col("left"), F.lit(None).cast("long").alias("digit")),
            lambda acc, x: F.when(acc["digit"].isNotNull(), acc)
            .when(x["n"] > acc["left"], F.struct(acc["left"].alias("left"), x["digit"].alias("digit")))
            .otherwise(F.struct((acc["left"] - x["n"]).alias("left"), F.lit(None).cast("long").alias("digit"))))
        end = (F.col("prefix") + 1) * (1 << DIGIT)
        nxt = (steps.withColumn("w", walk)
               .select("cut_source", "last", F.col("w.left").alias("left"), F.coalesce("w.digit", end).alias("prefix")))
        missing = open_.select(F.col("cut_source").alias("s"), "last", "left", (F.col("prefix") * (1 << DIGIT)).alias("prefix"))
        open_ = cut_lineage(
            missing.join(nxt.withColumnsRenamed({"left": "l2", "prefix": "p2"}).drop("last"),
                         F.col("s").eqNullSafe(F.col("cut_source")), "left")
            .select(F.col("s").alias("cut_source"), "last", F.coalesce("l2", "left").alias("left"),
                    F.coalesce("p2", "prefix").alias("prefix")), "mix_cut")
    return open_.select("cut_source", F.col("prefix").alias("cut"))
