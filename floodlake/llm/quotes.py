"""Chat formatting by quotation linking.

A line that starts with ``>`` marks is quoted, once per mark (``> >`` counts
as two). Successive lines of one level form a passage; its lines are joined
(quoting may wrap them anew) and cut into sentences, which are normalised
(lower case, blanks collapsed, the end punctuation off) and hashed. As lines
without end punctuation (greetings, headings, lists) run on into the next
sentence when joined, there are up to four readings: all lines joined, those
of a paragraph, those up to one that does not begin in lower case, and every
line by itself. The same hashes, of all readings, are taken of every message's
own, unquoted text, and a join within the conversation finds the first message
that said a sentence. A passage belongs to the message that the largest part
of its characters comes from in any reading, if that is half of them or more
(ties: the earlier message). A message answers the origin of its
outermost linked passage; deeper levels are what that message quoted itself.

The text that comes back is without the passages that were linked (and the
lines that announce them); a passage that belongs to no message stays.

Reply order: a message without a link starts a thread of its own or, with
``follow``, answers the turn before it; an answer follows in the thread of the
message it answers. Threads stand by the turn of their first message, inside a
thread by depth and then turn, so every answer comes after what it answers:
``position`` counts the messages of a conversation in this order, from 0. The
turn before is found within blocks of turns and from the last turn of the block
before, and positions by a range partitioning: no conversation is gathered in
one task.

Defined cases: null text is a message without text; a null conversation or
turn is kept, never linked and without a position; rows that repeat (conv_id,
turn) are the same message to a link and each come back; an empty table gives
an empty result; columns of the input are kept in ``row``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, wrap

_MARKS = re.compile(r"^[ \t]*(?:>[ \t]?)+")
_INTRO = re.compile(r"^.{0,200}\b(wrote|writes|said|schrieb|escribió|a écrit) ?:[ \t]*$", re.I)
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_BLANKS = re.compile(r"\s+")

#: part of a passage's characters that must come from one message
COVER = 0.5
#: turns of a block in the search for the turn before
TURNS = 1024


def sentences(text: str) -> list[str]:
    """Normalised sentences; those without a letter or digit are left out."""
    found = (_BLANKS.sub(" ", s).strip().rstrip(".!?").strip().lower() for s in _SENTENCE.findall(_BLANKS.sub(" ", text)))
    return [s for s in found if any(c.isalnum() for c in s)]


def readings(text: str) -> list[list[str]]:
    """The sentences by each way to join the lines, equal ones once."""
    lines = [line.strip() for line in text.split("\n")]
    blank = [not a or not b for a, b in zip(lines, lines[1:])]
    anew = [end or not line[0].islower() for end, line in zip(blank, lines[1:])]
    found: list[list[str]] = []
    for ends in ([False] * len(blank), blank, anew, [True] * len(blank)):
        parts = [[lines[0]]]
        for end, line in zip(ends, lines[1:]):
            if end:
                parts.append([])
            parts[-1].append(line)
        one = [s for part in parts for s in sentences(" ".join(part))]
        if one not in found:
            found.append(one)
    return found


def split_quotes(text: str) -> list[tuple[int, str, str]]:
    """The text in parts, as (level, lines, content): level 0 is the message's
    own, without content; a passage's lines are as they stand, with a line that
    only announces them, and its content is without marks."""
    parts: list[tuple[int, list[str], list[str]]] = []
    for line in text.split("\n"):
        marks = _MARKS.match(line)
        level, rest = (marks.group().count(">"), line[marks.end():].strip()) if marks else (0, "")
        if not parts or parts[-1][0] != level:
            intro = [parts[-1][1].pop()] if level and parts and parts[-1][0] == 0 and _INTRO.match(parts[-1][1][-1]) else []
            if parts and not parts[-1][1]:
                parts.pop()
            parts.append((level, intro, []))
        parts[-1][1].append(line)
        parts[-1][2].append(rest)
    return [(level, "\n".join(lines), "\n".join(content) if level else "") for level, lines, content in parts]


def parse_quotes(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The message's own text, and the passages as (level, content) in order."""
    parts = split_quotes(text)
    return "\n".join(p for level, p, _ in parts if not level).strip("\n"), [(level, c) for level, _, c in parts if level]


_PARSED = ("parts array<struct<passage int, body string>>, said array<string>, "
           "quoted array<struct<level int, passage int, reading int, chars int, sentence string>>")


def _parse(text: Column) -> Column:
    @F.pandas_udf(f"struct<{_PARSED}>")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for t in texts:
                own, passages = parse_quotes(t or "")
                parts, k = [], 0
                for level, body, _ in split_quotes(t) if t is not None else []:
                    parts.append({"passage": k if level else -1, "body": body})
                    k += level > 0
                out.append((parts if t is not None else None, sorted({s for one in readings(own) for s in one}),
                            [{"level": level, "passage": k, "reading": n, "chars": len(s), "sentence": s}
                             for k, (level, passage) in enumerate(passages) for n, one in enumerate(readings(passage)) for s in one]))
            yield pd.DataFrame(out, columns=["parts", "said", "quoted"])
    return parse(text)


def link_quotes(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", role: str | None = None,
                follow: bool = False) -> DataFrame:
    """One row per input row: ``row`` (its columns), ``text`` without linked
    quotes, ``n_passages`` and ``n_linked`` of them, ``reply_to`` (turn of the
    message it answers, else null), ``thread`` (turn of the thread's first
    message), ``depth``, ``position``, and ``formatted`` ("role: text", where a
    ``role`` column is named, else the text)."""
    parsed = cut_lineage(
        wrap(messages).select("row", F.col(f"row.`{conv}`").alias("conv"), F.col(f"row.`{turn}`").alias("turn"),
                              F.xxhash64(F.col(f"row.`{text}`")).alias("msg"), _parse(F.col(f"row.`{text}`")).alias("p"))
        .select("row", "conv", "turn", "msg", "p.*"), "quotes_parsed")
    quoted = (parsed.select("conv", "turn", "msg", F.explode("quoted").alias("q"))
              .select("conv", "turn", "msg", "q.level", "q.passage", "q.reading", "q.chars",
                      F.xxhash64("q.sentence").alias("h"), F.col("q.sentence").alias("s")))
    wanted = quoted.select("conv", "h").distinct()
    # the first message of the conversation that said a quoted sentence
    first = (parsed.select("conv", "turn", F.explode("said").alias("s")).withColumn("h", F.xxhash64("s"))
             .join(wanted, ["conv", "h"], "left_semi")
             .groupBy("conv", "h", "s").agg(F.min("turn").alias("origin")))
    passage = ["conv", "turn", "msg", "passage", "level"]
    per_origin = (quoted.join(first, ["conv", "h", "s"], "left")
                  .withColumn("origin", F.when(F.col("origin") < F.col("turn"), F.col("origin")))
                  .groupBy(*passage, "reading", "origin").agg(F.sum("chars").alias("n")))
    best = cut_lineage(per_origin.groupBy(*passage, "reading")
                       .agg(F.sum("n").alias("all"),
                            F.max(F.when(F.col("origin").isNotNull(), F.struct("n", (-F.col("origin")).alias("o")))).alias("b"))
                       .where(F.col("b.n") >= COVER * F.col("all")), "quotes_best")
    links = (best.groupBy("conv", "turn")
             .agg(F.min(F.struct("level", "passage", (-F.col("b.n") / F.col("all")).alias("part"), (-F.col("b.o")).alias("to"))).alias("x"))
             .select("conv", "turn", F.col("x.to").alias("reply_to")))
    turns = parsed.where("conv is not null and turn is not null").select("conv", "turn").distinct()
    if follow:
        links = (turn_before(turns).join(links, ["conv", "turn"], "left")
                 .select("conv", "turn", F.coalesce("reply_to", "before").alias("reply_to")).where("reply_to is not null"))
    roots = _roots(cut_lineage(links, "quotes_links"))
    placed = with_position(turns.join(roots, ["conv", "turn"], "left").select(
        "conv", "turn", "reply_to", F.coalesce("root", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth")))
    # of one message: as many as it has passages
    gone = best.groupBy("conv", "turn", "msg").agg(F.collect_set("passage").alias("gone"))
    whole = parsed.select("row", "conv", "turn", "msg", "parts", F.coalesce(
        F.array_max(F.transform("quoted", lambda q: q["passage"])) + 1, F.lit(0)).alias("n_passages"))
    left = F.filter("parts", lambda p: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), p["passage"]))
    out = (whole.join(gone, ["conv", "turn", "msg"], "left").join(placed, ["conv", "turn"], "left")
           .withColumn("text", F.regexp_replace(F.array_join(F.transform(left, lambda p: p["body"]), "\n"), r"^\n+|\n+\z", "")))
    said = F.concat_ws(": ", F.col(f"row.`{role}`"), F.coalesce("text", F.lit(""))) if role else F.col("text")
    return out.select("row", F.col("conv").alias("conv_id"), "turn", "text", "n_passages", F.coalesce(F.size("gone"), F.lit(0)).alias("n_linked"),
                      "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"),
                      "position", said.alias("formatted"))


def turn_before(turns: DataFrame) -> DataFrame:
    """conv, turn, before: the next smaller turn of the conversation, null for the first."""
    x = turns.withColumn("block", F.floor(F.col("turn") / TURNS))
    ends = x.groupBy("conv", "block").agg(F.max("turn").alias("end"))
    ends = ends.select("conv", "block", F.lag("end").over(Window.partitionBy("conv").orderBy("block")).alias("end"))
    inside = F.lag("turn").over(Window.partitionBy("conv", "block").orderBy("turn"))
    return x.withColumn("inside", inside).join(ends, ["conv", "block"]).select("conv", "turn", F.coalesce("inside", "end").alias("before"))


def with_position(placed: DataFrame) -> DataFrame:
    """``placed`` with the place of every message in its conversation's reply order."""
    order = ["conv", "thread", "depth", "turn"]
    rows = cut_lineage(placed.repartitionByRange(*order).sortWithinPartitions(*order)
                       .withColumn("id", F.monotonically_increasing_id()), "quotes_placed")
    rows = rows.withColumn("range", F.call_function("shiftright", F.col("id"), F.lit(33)))
    # of a conversation in one range: its first row there, and its rows in the ranges before
    per = rows.groupBy("conv", "range").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("conv", "range", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"))
    return (rows.join(per, ["conv", "range"])
            .select("conv", "turn", "reply_to", "thread", "depth", (F.col("id") - F.col("first") + F.col("n")).alias("position")))


def _roots(links: DataFrame) -> DataFrame:
    """First message and depth of every linked message, by doubling: each
    round follows all the links found so far, so a chain of n answers takes
    log2(n) rounds. Messages that have met their first one rest."""
    at = links.select("conv", "turn", "reply_to", F.col("reply_to").alias("root"), F.lit(1).alias("depth"), F.lit(False).alias("done"))
    while True:
        up = at.select("conv", F.col("turn").alias("root"), F.col("root").alias("r2"), F.col("depth").alias("d2"), F.col("done").alias("e2"))
        moved = (at.where("not done").join(up, ["conv", "root"], "left")
                 .select("conv", "turn", "reply_to", F.coalesce("r2", "root").alias("root"),
                         (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.coalesce("e2", F.lit(True)).alias("done")))
        at = cut_lineage(at.where("done").unionByName(moved), "quotes_roots")
        if at.where("not done").isEmpty():
            return at.drop("done")
