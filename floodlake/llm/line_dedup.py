"""Line deduplication that can be taken back: sharded cuckoo filters in front
of exact reference tables.

A line's key is the line without blanks at its ends, A-Z in lower case, known
by its 128-bit hash (k1, k2). Keys of ``MIN_CHARS`` code points or more count.
A key keeps its lines in the document of smallest id that holds it; in all
other documents they go.

State (``LineIndex``), all tables in the shared checkpoint folder:

``refs``     one row per key and document that holds it: the exact references.
``filters``  a cuckoo filter per shard with one 16-bit fingerprint per live
             k1. A filter that fills up gets a further level of twice the
             buckets. Two bytes a key, so a shard's filter fits in a task
             where its references would not.
``hits``     the k1 that a filter has answered "known" for. A key that is not
             in here has one reference: only these few ever need counting.

``insert`` deals the distinct k1 of a batch to their shards as packed arrays
(a hot line comes once per array, not once per document) and lets the filter
answer. An answer "known" is a repeat, or a false positive that the exact
references disprove; then the key gets a fingerprint of its own, so that
every live k1 has exactly one and ``remove`` can take it out again.
``counts`` are the exact reference counts of the keys that were hit, and
``drop_lines`` applies them to documents.

Defined cases: null text counts as empty, which is one empty line; rows that
share an id are one document (their lines stay or go alike, by the id); a
null id is larger than any other; rows that repeat are each returned; an
empty table gives an empty result; extra columns are not read; lines of any
length are hashed whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

MIN_CHARS = 10
#: references that a shard is meant for; the number of shards follows from the first batch
PER_SHARD = 2_000_000
#: references whose k1 a task gathers before it sends them to the shards
GATHER = 500_000
SLOTS, KICKS, FULL = 4, 100, 0.9
BLANKS = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The 128-bit key of a line; None if it is too short to count."""
    from xxhash import xxh3_128_digest
    key = line.strip(BLANKS).lower()    # of bytes: only A-Z change
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8")) < min_chars):
        return None
    return xxh3_128_digest(key)


class CuckooFilter:
    """Fingerprints of 64-bit keys in levels of buckets; each level has twice
    the buckets of the one before. All operations take arrays of keys."""

    def __init__(self, levels: list[np.ndarray] | None = None):
        self.levels = levels or []

    @staticmethod
    def _places(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = keys.view(np.uint64)
        prints = ((keys >> np.uint64(24)) & np.uint64(0xFFFF)).astype(np.uint16)
        prints[prints == 0] = 1
        one = (keys & np.uint64(0xFFFFFF)).astype(np.int64) & (buckets - 1)
        return prints, one, one ^ CuckooFilter._jump(prints, buckets)

    @staticmethod
    def _jump(prints: np.ndarray, buckets: int) -> np.ndarray:
        """How far the two buckets of a fingerprint are apart (by exclusive or)."""
        return (prints.astype(np.int64) * 0x5BD1E995 >> 7) & (buckets - 1)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), bool)
        for level in self.levels:
            prints, one, two = self._places(keys, len(level))
            found |= ((level[one] == prints[:, None]) | (level[two] == prints[:, None])).any(axis=1)
        return found

    @staticmethod
    def _put(level: np.ndarray, at: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Fill free slots of the buckets; returns which fingerprints found none."""
        order = np.argsort(at, kind="stable")
        sorted_at = at[order]
        begin = np.r_[True, sorted_at[1:] != sorted_at[:-1]]
        rank = np.arange(len(at)) - np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))
        free = level[sorted_at] == 0
        match = free & (np.cumsum(free, axis=1) == rank[:, None] + 1)
        fits = match.any(axis=1)
        level[sorted_at[fits], match[fits].argmax(axis=1)] = prints[order[fits]]
        left = np.ones(len(at), bool)
        left[order[fits]] = False
        return left

    def insert(self, keys: np.ndarray) -> None:
        """One fingerprint per key given, whether or not it is there already."""
        while len(keys):
            if not self.levels or np.count_nonzero(self.levels[-1]) + len(keys) > FULL * self.levels[-1].size:
                need = 1 << max(6, math.ceil(math.log2(len(keys) / (SLOTS * FULL / 1.5))))
                self.levels.append(np.zeros((max(need, 2 * len(self.levels[-1]) if self.levels else 0), SLOTS), np.uint16))
            level = self.levels[-1]
            prints, one, two = self._places(keys, len(level))
            left = np.flatnonzero(self._put(level, one, prints))
            left = left[self._put(level, two[left], prints[left])] if len(left) else left
            homeless = [int(k) for k in left if not self._kick(level, int(two[k]), int(prints[k]), int(k))]
            if not homeless:
                return
            # a level too crowded for these: they go to the next one
            keys = keys[homeless]
            self.levels.append(np.zeros((2 * len(level), SLOTS), np.uint16))

    def _kick(self, level: np.ndarray, at: int, print_: int, seed: int) -> bool:
        """Make room by moving fingerprints to their other bucket; if that
        fails, everything is put back."""
        moves = []
        for k in range(KICKS):
            free = np.flatnonzero(level[at] == 0)
            if len(free):
                level[at, free[0]] = print_
                return True
            slot = (seed + 7 * k) % SLOTS
            moves.append((at, slot, int(level[at, slot])))
            print_, level[at, slot] = int(level[at, slot]), print_
            at ^= int(self._jump(np.array([print_], np.uint16), len(level))[0])
        for at, slot, old in reversed(moves):
            level[at, slot] = old
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Take out one fingerprint per key."""
        for key in keys:
            for level in self.levels:
                prints, one, two = self._places(np.array([key]), len(level))
                at = next(((b, s) for b in (int(one[0]), int(two[0])) for s in range(SLOTS) if level[b, s] == prints[0]), None)
                if at:
                    level[at] = 0
                    break

    def count(self) -> int:
        return sum(int(np.count_nonzero(level)) for level in self.levels)


@dataclass
class LineIndex:
    refs: DataFrame         # k1, k2, doc_id, body
    filters: DataFrame      # shard, level, slots
    hits: DataFrame         # k1
    shards: int


def line_refs(docs: DataFrame, ident: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """k1, k2, doc_id, body: the distinct keys of every document; ``body`` is
    a hash of the text, which tells rows of one id apart."""
    src = docs.select(F.col(f"`{ident}`").alias("doc_id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("body"),
                      F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            for k, text in enumerate(batch.column(2)):
                mine = {line_key(line, min_chars) for line in text.as_py().split(b"\n")} - {None}
                rows += [k] * len(mine)
                keys += mine
            both = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), batch.column(0).take(at), batch.column(1).take(at)],
                                             names=["k1", "k2", "doc_id", "body"])
    return src.mapInArrow(run, f"k1 long, k2 long, doc_id {src.schema['doc_id'].dataType.simpleString()}, body long")


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys.view(np.uint64) >> np.uint64(40)) % np.uint64(shards)).astype(np.int32)


def _to_shards(keys: DataFrame, op: str, shards: int) -> DataFrame:
    """shard, op, data, many: the distinct k1 of every task's stretch of rows,
    packed, and which of them the stretch holds more than once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(parts: list[np.ndarray]) -> pa.RecordBatch:
            uniq, n = np.unique(np.concatenate(parts), return_counts=True)
            shard = _shard(uniq, shards)
            order = np.argsort(shard, kind="stable")
            names, begin = np.unique(shard[order], return_index=True)
            packed = [[x.tobytes() for x in np.split(column[order], begin[1:])] for column in (uniq.astype("<i8"), n > 1)]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([op] * len(names)),
                                               *(pa.array(x, pa.binary()) for x in packed)], names=["shard", "op", "data", "many"])
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy())
                n += batch.num_rows
            if n >= GATHER:
                yield send(held)
                held, n = [], 0
        if held:
            yield send(held)
    return keys.select("k1").mapInArrow(run, "shard int, op string, data binary, many binary")


def _through_filters(filters: DataFrame | None, changes: DataFrame, fresh: bool) -> DataFrame:
    """kind, shard, level, slots, keys: every shard's new filter ("filter"),
    keys that were known already ("hit") and, of these, those that this batch
    has not inserted itself ("ask"). A shard's old filter comes first, then its
    packed keys one array after another, so a task holds one filter at a time.
    ``fresh``: there are no earlier references to ask, so a known key that
    this batch has not inserted is a false positive."""
    flow = changes.select("shard", "op", F.lit(0).alias("level"), "data", "many")
    if filters is not None:
        flow = flow.unionByName(filters.select("shard", F.lit("").alias("op"), "level", F.col("slots").alias("data"),
                                                     F.lit(None).cast("binary").alias("many")))
    n = max(1, int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    flow = flow.repartition(n, "shard").sortWithinPartitions("shard", F.col("op") != "", "level", "op")

    def answer(shard: int, cuckoo: CuckooFilter, hits: list, asks: list) -> pa.RecordBatch:
        rows = [("filter", shard, k, level.astype("<u2").tobytes(), None) for k, level in enumerate(cuckoo.levels)]
        for kind, parts in (("hit", hits), ("ask", asks)):
            if parts:
                rows.append((kind, shard, None, None, np.unique(np.concatenate(parts))))
        cols = list(zip(*rows)) or [()] * 5
        types = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["kind", "shard", "level", "slots", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cuckoo, own, hits, asks = None, CuckooFilter(), np.zeros(0, np.int64), [], []
        for batch in batches:
            for shard, op, _, data, many in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now:
                    if now is not None:
                        yield answer(now, cuckoo, hits, asks)
                    now, cuckoo, own, hits, asks = shard, CuckooFilter(), np.zeros(0, np.int64), [], []
                if not op:
                    cuckoo.levels.append(np.frombuffer(data, "<u2").reshape(-1, SLOTS).copy())
                    continue
                keys = np.frombuffer(data, "<i8")
                if op == "delete":
                    cuckoo.delete(keys)
                elif op == "add":
                    cuckoo.insert(keys)
                else:
                    known = cuckoo.contains(keys)
                    mine = np.isin(keys, own)
                    hits.append(keys[known | np.frombuffer(many, bool)])
                    new = keys[~mine] if fresh else keys[~known]
                    asks += [] if fresh else [keys[known & ~mine]]
                    cuckoo.insert(new)
                    own = np.concatenate([own, new])
        if now is not None:
            yield answer(now, cuckoo, hits, asks)
    return flow.mapInArrow(run, "kind string, shard int, level int, slots binary, keys array<bigint>")


def _filters(out: DataFrame) -> DataFrame:
    return out.where("kind = 'filter'").select("shard", "level", "slots")


def _keys(out: DataFrame, kind: str) -> DataFrame:
    return out.where(F.col("kind") == kind).select(F.explode("keys").alias("k1")).distinct()


def insert(index: LineIndex | None, docs: DataFrame, ident: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
           shards: int | None = None) -> LineIndex:
    """The index with the documents' lines added; None starts a new one."""
    new = cut_lineage(line_refs(docs, ident, text, min_chars), "line_refs")
    if index is None:
        shards = shards or max(16, math.ceil(new.count() / PER_SHARD))
        out = cut_lineage(_through_filters(None, _to_shards(new, "insert", shards), True), "line_filters")
        return LineIndex(new, _filters(out), cut_lineage(_keys(out, "hit"), "line_hits"), shards)
    out = cut_lineage(_through_filters(index.filters, _to_shards(new, "insert", index.shards), False), "line_filters")
    # known, but by no earlier reference: a false positive, which gets its own fingerprint
    false = cut_lineage(_keys(out, "ask").join(index.refs.select("k1").distinct(), "k1", "left_anti"), "line_false")
    filters = _filters(out)
    if not false.isEmpty():
        filters = _filters(cut_lineage(_through_filters(filters, _to_shards(false, "add", index.shards), False), "line_filters"))
    hits = cut_lineage(index.hits.union(_keys(out, "hit")).distinct(), "line_hits")
    return LineIndex(cut_lineage(index.refs.unionByName(new), "line_refs"), filters, hits, index.shards)


def remove(index: LineIndex, ids: DataFrame, ident: str = "doc_id") -> LineIndex:
    """The index without the documents of these ids: their references go, and
    the fingerprints of keys that have no reference left."""
    ids = ids.select(F.col(f"`{ident}`").alias("id")).distinct()
    here = F.col("doc_id").eqNullSafe(F.col("id"))
    rest = cut_lineage(index.refs.join(ids, here, "left_anti"), "line_refs")
    gone = cut_lineage(index.refs.join(ids, here, "left_semi").select("k1").distinct()
                       .join(rest.select("k1").distinct(), "k1", "left_anti"), "line_gone")
    out = cut_lineage(_through_filters(index.filters, _to_shards(gone, "delete", index.shards), False), "line_filters")
    return LineIndex(rest, _filters(out), cut_lineage(index.hits.join(gone, "k1", "left_anti"), "line_hits"), index.shards)


def _counted(index: LineIndex) -> tuple[DataFrame, DataFrame]:
    """The references of keys that were hit, and their counts."""
    refs = cut_lineage(index.refs.join(index.hits, "k1", "left_semi"), "line_hit_refs")
    per_doc = refs.groupBy("k1", "k2", "doc_id").agg(F.count("*").alias("rows"))
    counts = per_doc.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first"))
    return refs, cut_lineage(counts, "line_counts")


def counts(index: LineIndex) -> DataFrame:
    """k1, k2, n_docs, first (the smallest id): the exact reference counts of
    the keys that were hit; every other key of the index has one reference."""
    return _counted(index)[1]


def drop_lines(index: LineIndex, docs: DataFrame, ident: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, and the text that
    stays. Documents that the index does not hold keep their lines."""
    refs, known = _counted(index)
    repeats = known.where("n_docs > 1").select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "first")
    drops = (refs.join(repeats, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")))
             .where(~F.col("doc_id").eqNullSafe(F.col("first")))
             .groupBy(F.col("doc_id").alias("id"), F.col("body").alias("place")).agg(F.collect_set(F.struct("k1", "k2")).alias("gone")))
    src = docs.select(F.col(f"`{ident}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    met = (src.withColumn("body", F.xxhash64("text")).join(drops, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("body") == F.col("place")), "left")
           .select("doc_id", F.col("text").cast("binary").alias("text"), "gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, gone in zip(batch.column(1), batch.column(2)):
                text = text.as_py()
                n_lines.append(text.count(b"\n") + 1)
                n_dropped.append(0)
                if gone.is_valid and len(gone):
                    both = gone.values
                    out = set(np.stack([both.field("k1").to_numpy(), both.field("k2").to_numpy()], axis=1).astype("<i8").view("V16").ravel().tolist())
                    stay = [line for line in text.split(b"\n") if line_key(line, min_chars) not in out]
                    n_dropped[-1] = n_lines[-1] - len(stay)
                    text = b"\n".join(stay)
                kept.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
                                              pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "text"])
    kind = src.schema["doc_id"].dataType.simpleString()
    return met.mapInArrow(run, f"doc_id {kind}, n_lines long, n_dropped long, text string")
