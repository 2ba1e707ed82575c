"""Exact deduplication with streaming state.

Every document gives a digest (SHA-256 of its text without blanks). A
Structured Streaming aggregation keeps one state per digest, on disk
(RocksDB), without a watermark, so nothing ever expires: how many documents
had it, and which row stays (most characters, then smallest id, then text
hash, then the place where the row was landed, so exactly one) with its
locator (with the id it finds the content). Documents may arrive in any number of
batches; feeding more later continues the same state.

A digest that was hit again is checked by its full bytes: the texts of its
documents are fetched by id and locator, and the smallest and the largest
normalised text per digest must be equal. That is an aggregate with partial
results, so a group that holds a third of all rows is reduced in every task
first. Should two texts share a digest, the group is split by text.

Only DataFrame and SQL functions; executors run no Python.

Defined cases: null text counts as empty; empty texts are equal to each other
and to texts of blanks; ids may be of any type that can be ordered, and a null
id is larger than any other; rows that share an id, repeated rows included,
are rows of their own, of which one a group is kept and all carry its keep_id;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, cut_lineage, scratch_folder, strip_chars

#: MB of memory that all state stores of an executor share for caches and write buffers; the rest is on disk
STORE_MB = 128
#: state on disk, without files of some MB allocated ahead in every partition;
#: stores of a stream that has ended are closed at the next maintenance
_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": str(STORE_MB),
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
}


def normalised(text: Column) -> Column:
    return strip_chars(F.coalesce(text, F.lit("")), BLANKS)


def locator(text: Column) -> Column:
    """Finds a row's content among the rows of its id: the hash of its text as it is."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def with_digest(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest, n_chars, locator; works on a batch and on a stream."""
    t = F.col(f"`{text}`")
    return docs.select(F.col(f"`{ident}`").alias("doc_id"), F.unhex(F.sha2(normalised(t), 256)).alias("digest"),
                       F.length(F.coalesce(t, F.lit(""))).cast("long").alias("n_chars"), locator(t).alias("locator"))


@contextmanager
def _rocksdb(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _order(row: Column) -> Column:
    """The row of a group that stays is the smallest in this order."""
    return F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator", row.alias("row"))


def feed_state(stream: DataFrame, state_dir: str) -> None:
    """Fold all that the stream has now into the state in ``state_dir``. A
    column ``row`` of the stream tells rows apart that are equal in all else."""
    best = F.min(_order(F.col("row") if "row" in stream.columns else F.lit(0).cast("long"))).alias("best")
    with _rocksdb(stream.sparkSession):
        (stream.groupBy("digest").agg(F.count("*").alias("n"), best)
         .writeStream.outputMode("update").format("noop").option("checkpointLocation", state_dir)
         .trigger(availableNow=True).start().awaitTermination())


def read_state(spark: SparkSession, state_dir: str) -> DataFrame:
    """digest, group_size, keep_id, keep_locator, keep_row of every digest ever fed."""
    with _rocksdb(spark):
        state = cut_lineage(spark.read.format("statestore").load(state_dir), "dedup_state")
    value = state.schema["value"].dataType
    n, best = (f"value.`{f.name}`" for f in value.fields)
    return state.select("key.digest", F.col(n).alias("group_size"), *_kept(best))


def _kept(best: str) -> list[Column]:
    return [F.col(f"{best}.doc_id").alias("keep_id"), F.col(f"{best}.locator").alias("keep_locator"), F.col(f"{best}.row").alias("keep_row")]


def dedup(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, digest, keep_id, group_size, kept, keep_locator."""
    spark = docs.sparkSession
    # the digests are landed once; the stream reads them as it would read new files
    feed_dir, state_dir = scratch_folder(spark, "dedup_feed"), scratch_folder(spark, "dedup_state")
    landed = with_digest(docs, ident, text).withColumn("row", F.monotonically_increasing_id())
    landed.write.parquet(feed_dir)
    feed = spark.read.schema(landed.schema).parquet(feed_dir)
    feed_state(spark.readStream.schema(landed.schema).parquet(feed_dir), state_dir)
    state = read_state(spark, state_dir)
    clash = cut_lineage(_clashes(docs, feed, state, ident, text), "dedup_clashes")
    groups = feed.select("doc_id", "digest", "row").join(state, "digest")
    if not clash.isEmpty():
        groups = _split(docs, feed, groups, clash, ident, text)
    return groups.select("doc_id", "digest", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "keep_locator")


def _clashes(docs: DataFrame, feed: DataFrame, state: DataFrame, ident: str, text: str) -> DataFrame:
    """Digests whose documents differ in their full bytes."""
    hits = feed.join(state.where("group_size > 1").select("digest"), "digest", "left_semi").select("doc_id", "locator").distinct()
    texts = docs.select(F.col(f"`{ident}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), locator(F.col(f"`{text}`")).alias("locator"))
    # the hits grow with the corpus: a merge join at every size, not a broadcast while they are few
    again = (texts.join(hits.hint("merge"), texts.doc_id.eqNullSafe(hits.doc_id) & (texts.locator == hits.locator), "left_semi")
             .select(normalised(F.col("text")).alias("body")).withColumn("digest", F.unhex(F.sha2("body", 256))))
    return (again.groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high"))
            .where("low <> high").select("digest"))


def _split(docs: DataFrame, feed: DataFrame, groups: DataFrame, clash: DataFrame, ident: str, text: str) -> DataFrame:
    """Groups again, by full text for the digests in ``clash``."""
    body = normalised(F.col(f"`{text}`"))
    texts = (docs.select(F.unhex(F.sha2(body, 256)).alias("digest"), locator(F.col(f"`{text}`")).alias("locator"), body.alias("body"))
             .join(clash, "digest", "left_semi").distinct())
    rows = feed.join(clash, "digest", "left_semi").join(texts, ["digest", "locator"])
    by_text = rows.groupBy("digest", "body").agg(F.count("*").alias("group_size"), F.min(_order(F.col("row"))).alias("best"))
    split = rows.join(by_text, ["digest", "body"]).select("digest", "doc_id", "row", "group_size", *_kept("best"))
    return groups.join(clash, "digest", "left_anti").unionByName(split)
