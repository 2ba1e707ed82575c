import random

import pytest

import brute
from floodlake.llm import spelling


@pytest.mark.parametrize("which", ["edge", "clashing", "docs", "none"])
def test_variants_equal_brute_force(spark, which, request):
    df = request.getfixturevalue(which)
    counts = brute.spelling_counts([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    got = brute.sort_rows(spelling.variants(spelling.count_words(df, typo_every=31)))
    assert got == sorted(brute.spelling_rows(counts), key=str)


def test_runs_ties_chains_and_long_words(spark):
    """Runs of equal letters, one-letter and very long words, words that are prefixes and suffixes of others, and chains of forms."""
    rnd = random.Random(8)
    counts = {"".join(rnd.choice("abÿ") for _ in range(rnd.randint(1, 6))): rnd.choice([2, 3, 20, 30, 200, 3000]) for _ in range(500)}
    counts |= {"a" * k: 10 ** (k % 4) for k in (1, 2, 3, 9, 10, 11, 12)} | {"x" * 5000: 5, "x" * 5001: 50, "x" * 2500 + "y" + "x" * 2499: 500}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(7)
    got = brute.sort_rows(spelling.variants(df))
    want = brute.spelling_rows({w: n for w, n in counts.items() if len(w) < 1000})
    assert [r for r in got if len(r[0]) < 1000] == sorted(want, key=str)
    x, more, y = "x" * 5000, "x" * 5001, "x" * 2500 + "y" + "x" * 2499
    assert {r for r in got if len(r[0]) >= 1000} == {(x, y, y, 5, 2, 500), (more, None, more, 50, 1, None), (y, None, y, 500, 1, None)}


def test_numbers_are_the_same_whatever_the_partitions(spark):
    rnd = random.Random(9)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 9))) for _ in range(400)})
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    for parts in ("1", "5", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            listed, same = spelling.number_nodes(df, "word", "test_nodes")
            rows = listed.orderBy("place").collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert [r.word for r in rows] == words
        by_prefix: dict = {}
        for r in rows:
            for k, number in enumerate(r.nodes):
                by_prefix.setdefault(r.word[:k], set()).add(same.get(number, number))
        assert all(len(v) == 1 for v in by_prefix.values())       # one number a node
        assert len({next(iter(v)) for v in by_prefix.values()}) == len(by_prefix)
        shared = {w[:k] for a, b in zip(words, words[1:]) for w in (a,) for k in range(spelling.common(a, b) + 1)}
        assert shared <= set(by_prefix)
