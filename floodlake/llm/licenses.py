"""License scans by diagonal voting.

Every text becomes words (lower case); all rolling 2-word grams are hashed
and joined to the positions of the same grams in a fixed set of license
templates. A hit at word ``pos`` of the text and ``tpos`` of the template
votes for the diagonal ``pos - tpos``: a copy of the template puts all its
votes on one diagonal, an inserted or lost word moves the rest to a
neighbouring one. Votes are counted per (text, template, diagonal) before
anything is shuffled, neighbouring diagonals that follow each other are
merged to spans, and spans are verified: grams are compared as text, a base
phrase must stand whole, a template must be covered by ``COVER`` of its grams
within a span of its length, and must hit all its grams with a number (the
version and what stands before it tell a license from its relatives: "by 4"
is no part of "by nc 4"). Where spans of different labels overlap, the one
with the higher cover stays, of equal ones that with more grams.

The templates are a fixed table of a few hundred rows, so the join is a
broadcast of bounded size. Grams never leave their task unless they hit.

Defined cases: null text has no words; a text of less than two words has no
grams; rows that repeat are each returned; extra columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: (label, phrase, whole): fixed wordings; ``whole`` phrases count where their words stand consecutively
BASE_PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
TEMPLATES = (
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl-3.0", "gnu affero general public license version 3"),
    ("mit", "released under the mit license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "licensed under cc by nc nd 4 0"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
COVER = 0.75
#: merge diagonals at most this far apart, when the next votes start within this many words
NEAR, GAP = 2, 6

_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SENTINEL = -1


def license_words(text: Column) -> Column:
    """Lower-cased words. Only A-Z matter: ``lower`` is as good once the two
    letters whose lower case is ASCII (Kelvin sign, dotted I) are replaced by
    another letter."""
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")), F.lit("\u0130"), F.lit("\u0138"))
    return F.array_remove(F.split(F.lower(plain), _SPLIT), "")


def template_grams(spark: SparkSession, base=BASE_PHRASES, templates=TEMPLATES) -> DataFrame:
    """h, tgram, tid, tpos, total (grams of the template), musts (those of them
    with a number), must, label; template 0 is the mark that every text hits once."""
    rows = [("", 0, _SENTINEL, 1, 0, 0, "")]
    for tid, (label, phrase) in enumerate((*base, *templates), 1):
        words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", phrase)
        pairs = list(zip(words, words[1:]))
        must = [int(any(c.isdigit() for c in a + b)) for a, b in pairs]
        rows += [(f"{a} {b}", tid, k, len(pairs), sum(must), must[k], label) for k, (a, b) in enumerate(pairs)]
    return (spark.createDataFrame(rows, "tgram string, tid int, tpos int, total int, musts int, must int, label string")
            .select(F.xxhash64("tgram").alias("h"), "*"))


def scan_licenses(docs: DataFrame, ident: str = "doc_id", text: str = "text", base=BASE_PHRASES,
                  templates=TEMPLATES) -> DataFrame:
    """One row per input row: ident, n_words, n_base, first_word, last_word,
    base_labels, labels, score, and ``spans`` (label, first word, number of
    words, covered part) of all verified spans."""
    spark = docs.sparkSession
    grams = F.broadcast(template_grams(spark, base, templates))
    words = docs.select(F.col(f"`{ident}`").alias("doc_id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("body"),
                        license_words(F.col(f"`{text}`")).alias("words"))
    # a leading empty gram marks the text itself, so texts without hits stay in the same flow
    pairs = F.transform(F.array(F.col("words")), lambda w: F.concat(
        F.array(F.lit("")),
        F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))),
                    lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1)))))
    hits = (words.select("doc_id", "body", F.size("words").cast("long").alias("n_words"), F.posexplode(F.element_at(pairs, 1)))
            .select("doc_id", "body", "n_words", (F.col("pos") - 1).alias("pos"), "col", F.xxhash64("col").alias("h"))
            .join(grams, "h").where("col = tgram"))
    key, about = ["doc_id", "body", "n_words"], ["total", "musts", "label"]
    # votes per diagonal; equal rows vote together and are told apart again by the mark's votes
    votes = (hits.withColumn("diag", F.col("pos") - F.col("tpos"))
             .groupBy(*key, "tid", "diag").agg(F.count("*").alias("n"), F.sum("must").alias("hit"), F.min("pos").alias("first"),
                                               F.max("pos").alias("last"), *[F.first(c).alias(c) for c in about]))
    by_text = Window.partitionBy(*key)
    votes = (votes.withColumn("copies", F.max(F.when(F.col("tid") == 0, F.col("n"))).over(by_text))
             .withColumn("n", F.col("n") / F.col("copies")).withColumn("hit", F.col("hit") / F.col("copies")))
    along = Window.partitionBy(*key, "tid").orderBy("first", "diag")
    begins = (F.lag("diag").over(along).isNull() | (F.abs(F.col("diag") - F.lag("diag").over(along)) > NEAR)
              | (F.col("first") - F.lag("last").over(along) > GAP))
    n_base = len(base)
    is_base = F.col("tid").between(1, n_base)
    # a base phrase is repeated side by side at most by its own length apart: its diagonals are never merged
    spans = (votes.withColumn("new", F.when(is_base | begins, 1).otherwise(0))
             .withColumn("span", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
             .groupBy(*key, "copies", "tid", "span")
             .agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"), F.min("first").alias("first"), F.max("last").alias("last"),
                  *[F.first(c).alias(c) for c in about])
             .withColumn("cover", F.least(F.col("n") / F.col("total"), F.lit(1.0))))
    length = F.col("last") - F.col("first") + 2
    whole = is_base & (F.col("n") == F.col("total")) & (length == F.col("total") + 1)
    fits = (~is_base & (F.col("tid") > 0) & (F.col("cover") >= COVER) & (F.col("hit") >= F.col("musts"))
            & (length <= F.col("total") + 1 + GAP))
    # spans of templates that touch each other form a stretch; in it, the best span drives out those of other labels that it overlaps
    in_order = Window.partitionBy(*key, "fits").orderBy("first", "last", "tid")
    spans = spans.withColumn("fits", fits)
    reach = F.max("last").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    spans = (spans.withColumn("apart", F.when(F.col("first") <= reach, 0).otherwise(1))
             .withColumn("stretch", F.sum("apart").over(in_order.rowsBetween(Window.unboundedPreceding, 0))))
    best = F.max(F.struct("cover", "n", -F.col("first"), "last", "label")).over(Window.partitionBy(*key, "fits", "stretch"))
    spans = spans.withColumn("best", best)
    beaten = ((F.col("label") != F.col("best.label")) & (F.col("last") >= -F.col("best.col3")) & (F.col("first") <= F.col("best.last"))
              & (F.struct("cover", "n") < F.struct(F.col("best.cover"), F.col("best.n"))))
    verified = whole | (F.col("fits") & ~beaten)
    out = spans.groupBy(*key, "copies").agg(
        F.count(F.when(whole, 1)).alias("n_base"),
        F.min(F.when(whole, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(whole, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(whole, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(verified, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(verified, F.col("cover"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(verified, F.struct(
            "first", length.alias("words"), "label", "cover")))).alias("spans"))
    return (out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long"))))
            .select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"))
