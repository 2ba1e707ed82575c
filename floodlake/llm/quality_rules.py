"""Quality rules with host-level verdicts, in DataFrame operations only.

Per document: counts of words, word characters, symbols, repeated lines and
words in repeated 3-word windows, all inside one row (arrays and their
higher-order functions), so the texts are not shuffled. Two rules make a
document fail: too few words, too many repeated ones.

Per host: failures are counted by host. Rates of small hosts say little, so
they are shrunk with a beta prior fitted to all hosts by moments: with mean m
and between-host variance v (the observed variance less its binomial part),
the prior has strength k = m (1 - m) / v - 1, and the shrunk rate is
(failures + k m) / (documents + k). A host is rejected when its shrunk rate
is ``host_limit`` or more: then even its passing documents go. The verdicts
are joined back to the documents.

Defined cases: null text has no words and fails; a null host is a host of its
own; texts of any length are read whole; rows that repeat are each judged; an
empty table gives an empty result; all columns of the input are kept in
``row`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, cut_lineage, let, strip_chars, words_of, wrap

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
HOST_LIMIT = 0.8
#: strength of the prior when hosts differ no more than chance explains
FIRM = 1e6

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: Column) -> Column:
    """Number of words inside 3-word windows that occur twice or more: sort
    the window hashes with their places, keep those equal to a neighbour, and
    count the places they cover. Within one text, windows are told apart by the
    64-bit hash of their words."""
    windows = lambda w: F.array_sort(F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))
    twice = lambda s: F.filter(s, lambda x, k: (
        (F.get(s, k + 1)["h"].eqNullSafe(x["h"])) | ((k > 0) & F.get(s, F.greatest(k - 1, F.lit(0)))["h"].eqNullSafe(x["h"]))))
    covered = lambda d: F.size(F.array_distinct(F.flatten(F.transform(
        d, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    return let(words, lambda w: let(windows(w), lambda s: covered(twice(s)))).cast("long")


def text_stats(text: Column) -> Column:
    """All counts of a text in one struct (fields ``STATS``)."""
    def build(t: Column) -> Column:
        plain = strip_chars(t, BLANKS)
        lines = F.filter(F.split(t, "\n"), lambda line: F.length(strip_chars(line, BLANKS)) > 0)
        return let(words_of(t), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(plain).cast("long").alias("word_chars"),
            (F.length(t) - F.length(strip_chars(t, tuple(SYMBOLS)))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words")))
    return let(F.coalesce(text, F.lit("")), build)


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])


def host_verdicts(judged: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """host, host_docs, host_rate (shrunk), host_ok; from columns host, base_failed."""
    by = judged.groupBy("host").agg(F.count("*").alias("host_docs"), F.count_if("base_failed").alias("failed"))
    n, f = F.col("host_docs"), F.col("failed")
    total = by.agg(F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(f * f / n).alias("ss"), F.count("*").alias("hosts"))
    m = F.col("f") / F.col("n")
    # weighted variance of the host rates, less what drawing n documents adds to it
    v = F.col("ss") / F.col("n") - m * m - m * (1 - m) * F.col("hosts") / F.col("n")
    # two numbers for the whole corpus
    prior = total.select(m.alias("m"), F.when(v > 0, F.greatest(m * (1 - m) / v - 1, F.lit(0.0))).otherwise(FIRM).alias("k")).first()
    mean, k = (F.lit(x).cast("double") for x in prior)
    rate = (f + k * mean) / (n + k)
    return by.select("host", "host_docs", rate.alias("host_rate"), (rate < limit).alias("host_ok"))


def judge_quality(docs: DataFrame, text: str = "text", host: str = "source", limit: float = HOST_LIMIT,
                  carry: tuple[str, ...] | None = None) -> DataFrame:
    """One row per input row: ``row`` (its columns, or those of ``carry``),
    the counts, base_failed, host_rate and kept. The counts are written once
    with the carried columns, since both the hosts and the documents read them."""
    src = wrap(docs)
    row = F.col("row") if carry is None else F.struct(*[F.col(f"row.`{c}`") for c in carry])
    judged = cut_lineage(
        src.select(row.alias("row"), F.col(f"row.`{host}`").alias("host"), text_stats(F.col(f"row.`{text}`")).alias("s"))
        .select("row", "host", "s.*", base_failed(F.col("s")).alias("base_failed")), "quality")
    # written first, so that the join knows its size: texts are not shuffled by host while the verdicts are few
    hosts = cut_lineage(host_verdicts(judged.select("host", "base_failed"), limit).withColumnRenamed("host", "h"), "quality_hosts")
    return (judged.join(hosts, F.col("host").eqNullSafe(F.col("h")), "left")
            .select("row", "host", *STATS, "base_failed", "host_rate", (~F.col("base_failed") & F.col("host_ok")).alias("kept")))
