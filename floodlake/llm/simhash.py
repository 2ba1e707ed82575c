"""SimHash near-duplicates with pigeonring filtering.

A text becomes the 64-bit SimHash of its word shingles (xxHash64, seed 42).
Fingerprints link when they differ in at most two bits; the classes are the
connected components.

Candidates. The 64 bits are cut into three segments on a ring. If two
fingerprints differ in at most 2 bits, there is a segment from which every
chain of l consecutive segments differs in at most 2 l / 3 bits: none in the
first, at most one in the first two, at most two in all three (the pigeonring
principle). So a fingerprint looks up, from each of the three starts, the
pairs of segments (start equal, next one equal or one bit off), 66 keys of 42
to 43 bits; only fingerprints that satisfy the chain conditions meet at all,
and the full Hamming distance is checked at the meeting. Keys are nearly
unique at any size of the table, so meetings don't grow with its square.

Dense keys. Many versions of one text can crowd into a few keys, and all
their pairs are not needed: members of one key that also agree in the third
segment up to one bit are linked through that common neighbour, one row per
member. Keys with more than ``CROWD`` exact members go this way; it finds
the same links (any two members two bits apart in the third segment have a
neighbour between them) without pairs.

Classes come from repeated hooking to the smallest neighbour and pointer
jumping over tables in the shared checkpoint folder.

Defined cases: texts without words (null, empty) have fingerprint 0 and link
like any other; fewer words than a shingle give one shingle of them all; rows
with a null id link like any other, but count in no class's name, so a class
of them alone has a null one; classes that share their smallest id have the
same name, but a ``root_fp`` each; repeated rows come back each; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

SHINGLE, MAX_BITS, SEED = 3, 2, 42
#: (first bit, number of bits) of the three segments
SEGMENTS = ((0, 22), (22, 21), (43, 21))
CROWD = 64


def fingerprint(text: bytes, k: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of one text: a bit is set when it is in over half the shingle hashes."""
    from xxhash import xxh64_intdigest
    words = text.lower().split()    # bytes: only A-Z change, only the six ASCII blanks part
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(len(words) - k + 1, 1)
    begin = [0, *(ends[:n - 1] + 1).tolist()]
    end = ends[min(k, len(words)) - 1:].tolist()
    h = np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(begin, end)), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        bits = np.unpackbits(h[at:at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, ident: str = "doc_id", text: str = "text", k: int = SHINGLE, seed: int = SEED,
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), and the columns of ``carry``."""
    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            fps = np.array([fingerprint((t or "").encode("utf-8"), k, seed) for t in texts], np.uint64)
            yield pd.Series(fps.view(np.int64))
    return docs.select(F.col(f"`{ident}`").alias("doc_id"), simhash(F.col(f"`{text}`")).alias("fp"), *carry)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _mask(segment: int) -> int:
    at, n = SEGMENTS[segment % 3]
    return ((1 << n) - 1) << at


def _flips(segment: int) -> list[int]:
    at, n = SEGMENTS[segment % 3]
    return [1 << (at + b) for b in range(n)]


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(_signed(v)).cast("long") for v in values])


def _starts(fps: DataFrame) -> DataFrame:
    """Three rows per fingerprint: the start of the chain and its exact key."""
    chain = [_mask(s) | _mask(s + 1) for s in range(3)]
    return (fps.select("fp", F.posexplode(_longs(chain)).alias("start", "chain"))
            .select("fp", "start", "chain", F.col("fp").bitwiseAND(F.col("chain")).alias("key")))


def near_pairs(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) at one or two
    differing bits: every such pair outside crowded keys, and for crowded ones
    links through common neighbours that connect the same fingerprints."""
    own = cut_lineage(_starts(fps), "simhash_keys")
    crowds = cut_lineage(own.groupBy("start", "key").count().where(F.col("count") > crowd).select("start", "key"), "simhash_crowds")
    flips = F.array(*[_longs([0, *_flips(s + 1)]) for s in range(3)])
    looks = (own.withColumn("flip", F.explode(F.element_at(flips, F.col("start") + 1)))
             .select("start", F.col("key").bitwiseXOR(F.col("flip")).alias("key"), F.col("fp").alias("b"),
                     (F.col("flip") != 0).cast("int").alias("off")))
    sparse = own.join(crowds, ["start", "key"], "left_anti").select("start", "key", F.col("fp").alias("a"))
    pairs = (looks.join(sparse, ["start", "key"])
             .where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS))
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    # crowded keys: an exact member reaches all third segments one bit off, a member one bit off already only its own
    third = F.array(*[_longs([0, *_flips(s + 2)]) for s in range(3)])
    members = looks.join(crowds, ["start", "key"], "left_semi")
    rest = F.col("b").bitwiseAND(F.element_at(_longs([_mask(s + 2) for s in range(3)]), F.col("start") + 1))
    meets = (members.withColumn("rest", rest)
             .withColumn("spread", F.when(F.col("off") == 0, F.element_at(third, F.col("start") + 1))
                         .otherwise(F.array(F.lit(0).cast("long"))))
             .select("key", "b", "rest", F.explode("spread").alias("flip"))
             .select(F.col("key").bitwiseOR(F.col("rest").bitwiseXOR(F.col("flip"))).alias("centre"), "b"))
    stars = meets.groupBy("centre").agg(F.min("b").alias("a"), F.max("b").alias("most")).where("a <> most").select("centre", "a")
    crowded = meets.join(stars, "centre").where("a <> b").select("a", "b")
    return pairs.unionByName(crowded).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for every node of an edge
    (columns a, b; any comparable type). Rounds of hooking every node to its
    smallest neighbour and jumping to the end of the hooks; the graph of the
    roots that are left is the next round's, at most half as large."""
    edges = cut_lineage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "cc_edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    found = cut_lineage(nodes.withColumn("root", F.col("node")), "cc_roots")
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a"))
        hook = cut_lineage(both.groupBy("node").agg(F.min("to").alias("to"))
                           .select("node", F.least("node", "to").alias("to")), "cc_hooks")
        while True:
            up = hook.select(F.col("node").alias("to"), F.col("to").alias("up"))
            hook = cut_lineage(hook.join(up, "to").select("node", F.col("up").alias("to"), (F.col("up") != F.col("to")).alias("moved")), "cc_hooks")
            done = hook.where("moved").isEmpty()
            hook = hook.drop("moved")
            if done:
                break
        found = cut_lineage(
            found.join(hook.select(F.col("node").alias("root"), F.col("to").alias("next")), "root", "left")
            .select("node", F.coalesce("next", "root").alias("root")), "cc_roots")
        a = hook.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        b = hook.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        edges = cut_lineage(edges.join(a, "a").join(b, "b").where("ra <> rb")
                            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc_edges")
    return found


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", k: int = SHINGLE, seed: int = SEED,
                    crowd: int = CROWD, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, fp, root_fp (the smallest fingerprint of
    its class), component_id (the smallest id in it), and the columns of ``carry``."""
    prints = cut_lineage(fingerprints(docs, ident, text, k, seed, carry), "simhash_docs")
    # one node per distinct fingerprint; ids only name the classes, so a shared or missing one neither joins nor parts them
    reps = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash_fps")
    roots = components(near_pairs(reps.select("fp"), crowd)).withColumnRenamed("node", "fp")
    linked = cut_lineage(reps.join(roots, "fp"), "simhash_linked")
    names = cut_lineage(linked.groupBy("root").agg(F.min("rep").alias("name")), "simhash_names")
    # written out, so that the last join reads plain exchanges and a hot fingerprint can be split
    classes = cut_lineage(
        reps.join(linked.select("fp", "root").join(names, "root"), "fp", "left")
        .select("fp", F.coalesce("root", "fp").alias("root_fp"),
                F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("name")).alias("component_id")), "simhash_classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "root_fp", "component_id", *carry)


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
