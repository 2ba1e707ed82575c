import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from floodlake.llm import line_dedup


def run(spark, docs, **kw):
    index = line_dedup.insert(None, docs, **kw)
    return index, brute.sort_rows(line_dedup.drop_lines(index, docs).select("doc_id", "n_lines", "n_dropped", "text"))


@pytest.mark.parametrize("which", ["edge", "clashing", "docs", "none"])
def test_lines_equal_brute_force(spark, which, request):
    df = request.getfixturevalue(which)
    want = brute.line_rows([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert run(spark, df)[1] == sorted(want, key=str)


def state(index):
    """Live keys and the fingerprints of the filters."""
    keys = {r.k1 for r in index.refs.select("k1").distinct().collect()}
    prints = sum(np.count_nonzero(np.frombuffer(r.slots, "<u2")) for r in index.filters.collect())
    return keys, prints


def test_batches_and_deletions_are_exact_and_reversible(spark):
    rnd = random.Random(5)
    lines = [f"line number {k} of the pool" for k in range(60)] + ["short", "", "  Line Number 3 of the pool\t"]
    rows = [(d, "\n".join(rnd.choice(lines) for _ in range(rnd.randint(1, 8)))) for d in range(120)]
    rows += [(200, "only here, nowhere else"), (200, "line number 7 of the pool"), (None, "line number 7 of the pool\nthe line of no id"),
             (None, "the line of no id"), (201, rows[5][1]), (201, rows[5][1])]
    df = lambda some: spark.createDataFrame(some, "doc_id long, text string")
    whole = line_dedup.insert(None, df(rows), shards=3)
    parts = None
    for at in range(0, len(rows), 45):
        parts = line_dedup.insert(parts, df(rows[at:at + 45]), shards=3)
    for index in (whole, parts):
        got = brute.sort_rows(line_dedup.drop_lines(index, df(rows)))
        assert got == sorted(brute.line_rows(rows), key=str)
        keys, prints = state(index)
        assert len(keys) == prints
    # take a third of the documents out, the first holders of many lines among them
    gone = [0, 1, 2, 3, 200, None] + list(range(30, 60))
    left = [r for r in rows if r[0] not in gone]
    less = line_dedup.remove(parts, spark.createDataFrame([(g,) for g in gone], "doc_id long"))
    assert brute.sort_rows(line_dedup.drop_lines(less, df(left))) == sorted(brute.line_rows(left), key=str)
    keys, prints = state(less)
    assert len(keys) == prints
    # and back in again
    back = line_dedup.insert(less, df([r for r in rows if r[0] in gone]))
    assert brute.sort_rows(line_dedup.drop_lines(back, df(rows))) == sorted(brute.line_rows(rows), key=str)
    found = {(r.n_docs, r.first) for r in line_dedup.counts(back).where("n_docs > 1").collect()}
    assert found and all(n > 1 for n, _ in found)
    nothing = line_dedup.remove(back, df(rows).select("doc_id"))
    assert state(nothing) == (set(), 0)


def test_false_positives_of_the_filter_are_told_from_repeats(spark):
    """Keys whose fingerprint and buckets agree but which differ: each is kept once, and one can go without the other."""
    base = 0x0000_0000_1234_5678
    keys = [base | (k << 40) for k in range(40)]     # same low 40 bits: same fingerprint, same bucket
    df = lambda ks: spark.createDataFrame([(k, 1, k, 0) for k in ks], "k1 long, k2 long, doc_id long, body long")
    out = line_dedup._through_filters(None, line_dedup._to_shards(df(keys).coalesce(1), "insert", 1), True)
    assert sum(np.count_nonzero(np.frombuffer(r.slots, "<u2")) for r in line_dedup._filters(out).collect()) == 40
    out = line_dedup._through_filters(line_dedup._filters(out), line_dedup._to_shards(df(keys[:13]), "delete", 1), False)
    assert sum(np.count_nonzero(np.frombuffer(r.slots, "<u2")) for r in line_dedup._filters(out).collect()) == 27


def test_cuckoo_filter_keeps_what_it_was_given():
    rnd = np.random.default_rng(3)
    keys = rnd.integers(-(1 << 63), 1 << 63, 30_000, dtype=np.int64)
    cuckoo = line_dedup.CuckooFilter()
    for at in range(0, 30_000, 7_000):
        cuckoo.insert(keys[at:at + 7_000])
    assert len(cuckoo.levels) > 1 and cuckoo.count() == 30_000
    assert cuckoo.contains(keys).all()
    other = rnd.integers(-(1 << 63), 1 << 63, 100_000, dtype=np.int64)
    assert cuckoo.contains(other).mean() < 0.005
    cuckoo.delete(keys[:10_000])
    assert cuckoo.count() == 20_000 and cuckoo.contains(keys[10_000:]).all()
    assert cuckoo.contains(keys[:10_000]).mean() < 0.005


def test_other_id_types(spark):
    rows = [("b", "a line that is long enough\nx"), ("a", "A line that is long enough "), (None, "a line that is long enough")]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumn("gone", F.lit(1))
    got = {r.doc_id: (r.n_dropped, r.text) for r in line_dedup.drop_lines(line_dedup.insert(None, df), df).collect()}
    assert got == {"a": (0, rows[1][1]), "b": (1, "x"), None: (1, "")}


def test_query_digest(spark, docs):
    want = {d: hashlib.sha256(t.encode()).hexdigest() for d, _, _, t in brute.line_rows([(r.doc_id, r.text) for r in docs.collect()])}
    from floodlake.llm import queries
    assert {r.doc_id: r.kept_sha256 for r in queries.op11_line_dedup(spark, "/root/testdata/sf0.001").collect()} == want
