"""String functions as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings.

    Dynamic programme with higher-order functions: fold over the
    characters of ``a``; the accumulator is the DP row against every
    prefix of ``b``. Runs inside the JVM, no Python UDF.
    """
    n = F.length(b)

    def step(row: Column, ch: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), n), F.array(F.lit(0)),
            lambda acc, j: F.concat(acc, F.array(
                F.when(F.substr(b, j, F.lit(1)) == ch, row[j - 1] + 1)
                .otherwise(F.greatest(row[j], acc[j - 1])))))

    table = F.aggregate(F.split(a, ""), F.array_repeat(F.lit(0), n + 1), step)
    return F.when((F.length(a) == 0) | (n == 0), F.lit(0)).otherwise(F.element_at(table, -1))


def name_score(a: Column, b: Column) -> Column:
    """Similarity 0-100 of two names, case-insensitive:
    ``round_half_even(200 * LCS / (len a + len b))``; 0 if either is empty."""
    la, lb = F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit("")))
    total = F.length(la) + F.length(lb)
    raw = F.lit(200.0) * lcs_length(la, lb) / total
    return F.when((F.length(la) == 0) | (F.length(lb) == 0), F.lit(0)).otherwise(F.bround(raw, 0).cast("int"))


def unescape_unicode(c: Column) -> Column:
    """Decode literal ``\\uXXXX`` escapes (text without them is unchanged),
    using the JSON string decoder of ``get_json_object``."""
    quoted = F.concat(F.lit('{"v":"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"}'))
    decoded = F.get_json_object(quoted, "$.v")
    return F.when(c.contains("\\u"), F.coalesce(decoded, c)).otherwise(c)


def station_from_file(path: Column) -> Column:
    """'jerusalem_center_2010_2018.csv' -> 'Jerusalem Center': drop the
    extension and the last two '_' parts, title-case; a name with fewer
    parts keeps its first part."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.csv$", "")
    parts = F.split(stem, "_")
    kept = F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(0)))
    name = F.array_join(kept, " ")
    name = F.when(F.length(name) > 0, name).otherwise(F.element_at(parts, 1))
    # title case: every run of letters starts with a capital, also behind a hyphen
    return F.array_join(F.transform(F.regexp_extract_all(name, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1)), F.initcap), "")


def basin_from_file(path: Column, part: int = 1) -> Column:
    """'sorek_2010_2019.csv' -> 'Sorek' (``part`` = 1), or the second part
    for dataset files ('Flood_Beer_Sheva_...' -> 'Beer'); first letter
    upper, the rest lower."""
    base = F.element_at(F.split(path, "/"), -1)
    p = F.element_at(F.split(base, "_"), part)
    return F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, F.length(p))))


def last_updated(date: Column, time: Column) -> Column:
    """'date time'; NULL when either part is missing."""
    return F.when(date.isNotNull() & time.isNotNull(), F.concat_ws(" ", date, time))


def _lcs_bits(x: str, y: str) -> int:
    """Bit-parallel LCS length (Allison-Dix/Hyyro): one pass over ``x``
    with ``len(y)``-bit words; Python ints make any length exact."""
    if not x or not y:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(y):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(y)) - 1
    v = full
    for ch in x:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(y) - bin(v).count("1")


@F.pandas_udf(IntegerType())
def lcs_length_arrow(a: pd.Series, b: pd.Series) -> pd.Series:
    """LCS length per row, computed on Arrow batches."""
    return pd.Series([_lcs_bits(x or "", y or "") for x, y in zip(a, b)], dtype="int32")


def name_score_fast(a: Column, b: Column) -> Column:
    """``name_score`` with the LCS computed by the Arrow-batched kernel."""
    la, lb = F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit("")))
    raw = F.lit(200.0) * lcs_length_arrow(la, lb) / (F.length(la) + F.length(lb))
    return F.when((F.length(la) == 0) | (F.length(lb) == 0), F.lit(0)).otherwise(F.bround(raw, 0).cast("int"))
