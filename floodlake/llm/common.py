"""Helpers shared by the language-model operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floodlake.session import cut_lineage, scratch_folder

#: the six characters that separate words in the contracts
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
BLANK_RUN = r"[\x20\x09-\x0D]+"

__all__ = ["BLANKS", "BLANK_RUN", "cut_lineage", "scratch_folder", "let", "strip_chars", "words_of",
           "table", "held_out", "wrap", "unwrap"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once: a lambda variable cannot be
    inlined again by the optimizer, unlike a column of a lower projection."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_chars(text: Column, chars: tuple[str, ...] | str) -> Column:
    """``text`` without any of ``chars``; one plain scan per character."""
    for c in chars:
        text = F.replace(text, F.lit(c))
    return text


def words_of(text: Column) -> Column:
    """Words between blanks; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK_RUN), "")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that no model may learn from; a null id
    counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(0)) == 0


def wrap(df: DataFrame) -> DataFrame:
    """All columns in one struct ``row``: computed columns beside it cannot
    clash with the names of the input."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unwrap(df: DataFrame) -> DataFrame:
    return df.select("row.*")
