"""The training-data pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run``
writes every result as Parquet to the shared checkpoint folder and reads it
back as the next stage's documents. All stages but the last keep the columns
of their input, whatever else it holds; rows with null columns, empty and
very long texts, repeated rows and empty tables pass through as the operators
define them. Rows that share an id are told apart by a hash of their text;
a null id counts as larger than any other.

The ids that a deduplication keeps or drops grow with the corpus, so they
meet the documents in merge joins at every size, never in broadcasts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floodlake.llm import bpe, exact_dedup, mixing, quality_rules, simhash
from floodlake.llm.common import cut_lineage, table, unwrap, wrap

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and their host's verdict keep."""
    return unwrap(quality_rules.judge_quality(docs).where("kept"))


def _key(ident: Column) -> Column:
    return F.coalesce(ident.cast("string"), F.lit("null")).alias("key")


def _only(docs: DataFrame, stays: DataFrame) -> DataFrame:
    """One row for every (key, place) of ``stays``: by id and by the hash of the text.
    Rows that repeat both are reduced where they are read, before they meet ``stays``."""
    rows = wrap(docs).select("row", _key(F.col("row.doc_id")), exact_dedup.locator(F.col("row.text")).alias("place"))
    return unwrap(rows.dropDuplicates(["key", "place"]).join(stays.hint("merge"), ["key", "place"], "left_semi"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of equal texts, also of rows that repeat an id and its text."""
    return _only(docs, exact_dedup.dedup(docs).where("kept").select(_key(F.col("keep_id")), F.col("keep_locator").alias("place")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of every SimHash class (and of smallest
    text hash, where texts of the class share that id)."""
    located = docs.select("doc_id", "text", exact_dedup.locator(F.col("text")).alias("place"))
    found = simhash.near_duplicates(located, carry=("place",))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "place")).alias("first")
    stays = found.groupBy("root_fp").agg(first).select(_key(F.col("first.doc_id")), F.col("first.place").alias("place"))
    return _only(docs, stays)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed stream: every document once or more, by its source's budget."""
    return unwrap(mixing.mix(docs).select("row"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of the decoded text."""
    return bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN, keep=("doc_id", "lang", "source")).select(
        "doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("SimHash near-dedup", near),
          ("source mixing", mixed), ("byte-level BPE", tokens)]

#: SimHash needs xxHash64, which DuckDB lacks; tests/llm compares with brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), "pipeline_" + name.replace(" ", "_"))
    return docs
