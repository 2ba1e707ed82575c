"""Spelling variants by a dictionary of trie-node pairs.

The words of a corpus (``count_words``) are numbered in sorted order, and so
are the nodes of two tries: that of the words (a node is a prefix) and that of
the reversed words (a node is a suffix). A word with position i left out is
the pair (prefix node before i, suffix node behind i), a "gap"; a word cut
before i is the pair (prefix node, suffix node) around the cut, a "split".

- Two words differ by one replaced code point exactly when they share a gap.
- One word is another with one code point inserted exactly when a gap of the
  longer is a split of the shorter. Leaving out any of a run of equal code
  points gives the same word, so only the last of a run counts here.

So all neighbours come from one grouping by integer pairs, each exactly once.
A pair holds at most one split and one gap per letter of the alphabet, so its
group is small whatever the corpus.

Numbering. Words are range-partitioned and sorted; a task walks its stretch
with the common prefix of neighbours and gives every node that two of its
words share a number of its own (nodes of a single word join nothing, and
need none). A prefix may go on into the next stretch: the first and the last
word of every stretch, with their nodes, go to the driver (two rows a task),
which lists the nodes that are the same one.

A word's form is its neighbour of largest count, if that is ``ratio`` times
its own; roots follow forms to the end by pointer doubling.

Defined cases: null text has no words; a null id is written "null"; runs of
any length are whole words; an empty table gives an empty result; repeated
rows all count; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

MIN_CHARS, MIN_COUNT, RATIO = 7, 2, 10
#: distinct words that a task counts before it hands them on; rows of a batch it emits
HELD, EMIT = 200_000, 20_000
#: bytes of Latin-1: letters to themselves in lower case (A-Z only), all else to a blank
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
GAP, LAST_GAP, SPLIT = 1, 2, 0


def _words(text: str, ident: str, min_chars: int, typo_every: int | None) -> Counter:
    """Words of one text as Latin-1 bytes. With ``typo_every`` one in so many
    (by a hash of id and word) loses a letter."""
    # a code point beyond Latin-1 becomes one "?", which parts words as well
    found = Counter(w for w in text.encode("latin-1", "replace").translate(_LETTERS).split(b" ") if len(w) >= min_chars)
    if not typo_every:
        return found
    start, out = zlib.crc32(f"{ident}:".encode()), Counter()
    for word, n in found.items():
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
        if h % typo_every == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
            if len(word) < min_chars:
                continue
        out[word] += n
    return out


def count_words(docs: DataFrame, ident: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
                min_count: int = MIN_COUNT, typo_every: int | None = None) -> DataFrame:
    """word, n: lower-cased letter runs, counted within tasks first."""
    src = docs.select(F.coalesce(F.col(f"`{ident}`").cast("string"), F.lit("null")).alias("id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(held: Counter) -> Iterator[pa.RecordBatch]:
            items = list(held.items())
            for at in range(0, len(items), EMIT):
                words, n = zip(*items[at:at + EMIT])
                yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in words]), pa.array(n, pa.int64())], names=["word", "n"])
        held: Counter = Counter()
        for batch in batches:
            for ident, text in zip(batch.column(0), batch.column(1)):
                if text.is_valid:
                    for word, n in _words(text.as_py(), ident.as_py(), min_chars, typo_every).items():
                        held[word] += n
                    if len(held) >= HELD:
                        yield from send(held)
                        held.clear()
        yield from send(held)
    return (src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= min_count))


def common(a: str, b: str) -> int:
    """Code points that two words begin with in common."""
    k = 0
    for x, y in zip(a, b):
        if x != y:
            break
        k += 1
    return k


def _walk(words: Iterator[tuple[str, int]], base: int) -> Iterator[tuple[str, int, list[int]]]:
    """For sorted (word, payload): the numbers of the nodes on the word's path
    that a neighbour shares, from the root (0) down. The nodes of the first
    and the last word are numbered to their ends, as the next stretch may
    share them."""
    path: list[int] = []
    before, number = None, base
    ahead = next(words, None)
    while ahead is not None:
        (word, load), ahead = ahead, next(words, None)
        with_next = len(word) if ahead is None else common(word, ahead[0])
        with_last = len(word) if before is None else common(word, before)
        path = path[:with_last]
        new = max(with_next, with_last) - len(path)
        path += range(number + 1, number + 1 + new)
        number += max(new, 0)
        before = word
        yield word, load, [0, *path]


def number_nodes(words: DataFrame, key: str, name: str) -> tuple[DataFrame, dict[int, int]]:
    """Columns of ``words`` (key, wid or none, n), with the ``nodes`` of the
    key's path and a ``place`` in sorted order; and, of nodes that go on from
    an earlier stretch, that stretch's number."""
    cols = [c for c in words.columns if c != key]
    src = words.select(key, *cols).repartitionByRange(key).sortWithinPartitions(key)
    kinds = {f.name: f.dataType.simpleString() for f in src.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (TaskContext.get().partitionId() + 1) << 40
        rows = ((w, load) for batch in batches for w, *load in zip(*(c.to_pylist() for c in batch.columns)))
        out, last = [], None

        def send(edge: bool) -> pa.RecordBatch:
            cols = list(zip(*out))
            types = [src_type for src_type in (pa.string(), *[pa.int64()] * (len(cols) - 3), pa.list_(pa.int64()), pa.int64())]
            arrays = [pa.array(c, t) for c, t in zip(cols, types)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([edge] * len(out))], names=[*kinds, "nodes", "place", "edge"])
        for k, (word, load, nodes) in enumerate(_walk(rows, base)):
            out.append((word, *load, nodes, base + k))
            if k == 0:
                yield send(True)
            last = out[-1]
            if len(out) >= EMIT:
                yield send(False)
                out = []
        if out:
            yield send(False)
        if last:
            out = [last]
            yield send(True)
    numbered = cut_lineage(src.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", nodes array<bigint>, place long, edge boolean"), name)
    edges = numbered.where("edge").orderBy("place").select(key, "nodes", "place").collect()     # two rows a task
    same: dict[int, int] = {}
    for last, first in zip(edges[1::2], edges[2::2]):
        for k in range(1, common(last[0], first[0]) + 1):
            same[first.nodes[k]] = same.get(last.nodes[k], last.nodes[k])
    return numbered.where("not edge").drop("edge"), same


def node_pairs(words: DataFrame) -> DataFrame:
    """prefix, suffix, role, wid, n: the gaps and splits of all words
    (columns word, wid, n, and their forward and backward nodes come from the numbering)."""
    forward, same_f = number_nodes(words.select("word", "n"), "word", "spelling_forward")
    forward = forward.withColumnRenamed("place", "wid")
    backward, same_b = number_nodes(forward.select(F.reverse("word").alias("drow"), "wid"), "drow", "spelling_backward")
    both = forward.select("wid", "n", "word", F.col("nodes").alias("f")).join(backward.select("wid", F.col("nodes").alias("b")), "wid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["prefix", "suffix", "role", "wid", "n"]
        types = (pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.int64())
        out: list[tuple] = []
        for batch in batches:
            for wid, n, word, f, b in zip(*(c.to_pylist() for c in batch.columns)):
                f, b, size = [same_f.get(x, x) for x in f], [same_b.get(x, x) for x in b], len(word)
                for i in range(max(0, size - len(b)), min(size - 1, len(f) - 1) + 1):
                    out.append((f[i], b[size - 1 - i], LAST_GAP if i == size - 1 or word[i] != word[i + 1] else GAP, wid, n))
                for i in range(max(0, size - len(b) + 1), min(size, len(f) - 1) + 1):
                    out.append((f[i], b[size - i], SPLIT, wid, n))
                if len(out) >= EMIT:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
    return both.mapInArrow(run, "prefix long, suffix long, role byte, wid long, n long"), forward


def neighbours(pairs: DataFrame) -> DataFrame:
    """wid, n_near, near_n, near_wid: the number of near words, and the one of
    largest count (of equal counts the first in order)."""
    meets = (pairs.groupBy("prefix", "suffix").agg(F.collect_list(F.struct("n", (-F.col("wid")).alias("neg"), "role")).alias("m"))
             .where(F.size("m") > 1).select("m"))

    def near(x):
        return F.filter("m", lambda y: F.when(x["role"] == SPLIT, y["role"] == LAST_GAP)
                        .otherwise(((y["role"] != SPLIT) & (y["neg"] != x["neg"])) | ((y["role"] == SPLIT) & (x["role"] == LAST_GAP))))
    found = (meets.select(F.explode(F.transform("m", lambda x: F.struct(x["neg"].alias("neg"), near(x).alias("near")))).alias("e"))
             .where(F.size("e.near") > 0)
             .select((-F.col("e.neg")).alias("wid"), F.size("e.near").alias("k"), F.array_max("e.near").alias("best")))
    return (found.groupBy("wid").agg(F.sum("k").alias("n_near"), F.max("best").alias("best"))
            .select("wid", "n_near", F.col("best.n").alias("near_n"), (-F.col("best.neg")).alias("near_wid")))


def roots(forms: DataFrame) -> DataFrame:
    """wid, root: the end of the chain of forms (columns wid, form); a form
    has a larger count than its word, so chains end."""
    up = cut_lineage(forms.select("wid", F.col("form").alias("root")), "spelling_roots")
    while True:
        nxt = up.select(F.col("wid").alias("at"), F.col("root").alias("next"))
        up = cut_lineage(up.join(nxt, F.col("root") == F.col("at"), "left")
                         .select("wid", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling_roots")
        if up.where("moved").isEmpty():
            return up.select("wid", "root")
        up = up.select("wid", "root")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every distinct word (columns word, n)."""
    pairs, listed = node_pairs(words)
    near = cut_lineage(neighbours(pairs), "spelling_near")
    has = cut_lineage(listed.select("wid", "word", "n").join(near, "wid")
                      .withColumn("form", F.when(F.col("near_n") >= ratio * F.col("n"), F.col("near_wid"))), "spelling_forms")
    chains = roots(has.where("form is not null").select("wid", "form"))
    names = listed.select(F.col("wid").alias("at"), F.col("word").alias("name"))
    formed = (has.where("form is not null").join(chains, "wid")
              .join(names.withColumnRenamed("name", "form_word"), F.col("form") == F.col("at")).drop("at")
              .join(names.withColumnRenamed("name", "root_word"), F.col("root") == F.col("at"))
              .select("wid", "form_word", "root_word", F.col("near_n").alias("form_n")))
    return (listed.select("wid", "word", "n").join(near.select("wid", "n_near"), "wid", "left").join(formed, "wid", "left")
            .select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"))
