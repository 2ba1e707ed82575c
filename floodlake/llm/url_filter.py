"""URL filters: all wildcard rules simulated at once by a bit-parallel automaton.

Every rule is a glob over the canonical form ``.host/path`` of a URL:
``*`` is any run without ``/``, ``**`` any run, ``?`` one character but ``/``.
The states of all globs are packed side by side into 64-bit words (Shift-And
with self loops for the wildcards); one step over a character is

    D = ((D << 1) & enter[c]) | (D & stay[c])

for all globs and, with numpy, for all URLs of a batch together.

Defined cases: a null URL or one without ``://`` has an empty host and path
and is blocked by the glob ``.``; an empty table gives an empty result; rows
that repeat are each judged; columns beside the id and the URL are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"

#: host-and-path rules: (host, path prefix, verdict); the longest fitting rule decides
HOST_RULES = (("org", "/", ALLOW), ("example.org", "/es/", BLOCK), ("example.org", "/en/1", BLOCK),
              ("com", "/fr/", ALLOW), ("com", "/de/", BLOCK))

#: globs that block what no host rule decides: no host at all, gambling,
#: pharmacy, adult, spam and advertising hosts, and files that hold no prose
BLOCK_GLOBS = (".", "*casino*/**", "*casino*", "*.free-bets.*/**", "*.free-bets.*", "*cheap-pills*/**",
               "*cheap-pills*", "*.xxx/**", "*.xxx", "*adult*/**", "*adult*", "*porn*/**", "*porn*", "*spam*/**",
               "*spam*", "*.ads-*/**", "*.ads-*", "**.zip", "**.exe", "**.jpg", "**.png", "**.gif", "**.mp4",
               "**/wp-login.php**", "**/cgi-bin/**")

_ANY, _SEGMENT = "any", "segment"


@dataclass(frozen=True)
class Pattern:
    """``steps`` consumes one character each (None: any but ``/``);
    ``loops[j]`` is the run allowed after ``j`` steps (None, _SEGMENT or _ANY)."""
    steps: tuple[str | None, ...]
    loops: tuple[str | None, ...]


def glob_pattern(glob: str) -> Pattern:
    steps: list[str | None] = []
    loops: list[str | None] = [None]
    i = 0
    while i < len(glob):
        if glob[i] == "*":
            if glob[i:i + 2] == "**":
                loops[-1] = _ANY
                i += 2
                continue
            loops[-1] = loops[-1] or _SEGMENT
        else:
            steps.append(None if glob[i] == "?" else glob[i])
            loops.append(None)
        i += 1
    return Pattern(tuple(steps), tuple(loops))


def host_pattern(host: str, path: str) -> Pattern:
    """The host itself or a subdomain of it, and a path with that prefix, all
    of it literal: ``*.host/path**``."""
    text = f".{host}{path}"
    return Pattern(tuple(text), (_SEGMENT, *[None] * (len(text) - 1), _ANY))


class Automaton:
    """Multiword Shift-And over a list of patterns."""

    def __init__(self, patterns: Sequence[Pattern]):
        starts = np.cumsum([0] + [len(p.steps) + 1 for p in patterns])
        self.words = max(1, -(-int(starts[-1]) // 64))
        letters = sorted({c for p in patterns for c in p.steps if c} | {"/"})
        # class 0: every character that no pattern names
        self.codes = np.array([ord(c) for c in letters])
        n = len(letters) + 1
        slash = letters.index("/") + 1
        self.enter = np.zeros((n, self.words), np.uint64)
        self.stay = np.zeros((n, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.accept_at: list[tuple[int, np.uint64]] = []

        def bit(k: int) -> tuple[int, np.uint64]:
            return k // 64, np.uint64(1 << (k % 64))

        for p, at in zip(patterns, starts[:-1].tolist()):
            w, m = bit(at)
            self.start[w] |= m
            for j, c in enumerate(p.steps, 1):
                w, m = bit(at + j)
                if c is None:
                    self.enter[:, w] |= m
                    self.enter[slash, w] &= ~m
                else:
                    self.enter[letters.index(c) + 1, w] |= m
            for j, loop in enumerate(p.loops):
                if loop:
                    w, m = bit(at + j)
                    self.stay[:, w] |= m
                    if loop == _SEGMENT:
                        self.stay[slash, w] &= ~m
            self.accept_at.append(bit(at + len(p.steps)))

    def match(self, texts: Sequence[str]) -> np.ndarray:
        """Boolean matrix: text x pattern."""
        n = len(texts)
        lens = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lens, kind="stable")
        lens = lens[order]
        chars = np.frombuffer("".join(texts[i] for i in order).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.searchsorted(self.codes, chars)
        hit = self.codes[np.minimum(at, len(self.codes) - 1)] == chars
        classes = np.where(hit, at + 1, 0)
        offset = np.concatenate([[0], np.cumsum(lens)[:-1]]) if n else np.zeros(0, np.int64)
        state = np.tile(self.start, (n, 1))
        one, top = np.uint64(1), np.uint64(63)
        live = n
        for t in range(int(lens[0]) if n else 0):
            while live and lens[live - 1] <= t:
                live -= 1
            d = state[:live]
            c = classes[offset[:live] + t]
            shifted = d << one
            shifted[:, 1:] |= d[:, :-1] >> top
            state[:live] = (shifted & self.enter[c]) | (d & self.stay[c])
        found = np.zeros((n, len(self.accept_at)), bool)
        for k, (w, m) in enumerate(self.accept_at):
            found[order, k] = (state[:, w] & m) != 0
        return found


@lru_cache(maxsize=8)
def _compiled(rules: tuple, globs: tuple) -> Automaton:
    return Automaton([host_pattern(h, p) for h, p, _ in rules] + [glob_pattern(g) for g in globs])


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                       "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence = HOST_RULES,
               block_globs: Sequence[str] = BLOCK_GLOBS) -> DataFrame:
    """One row per input row: id, host, path, the longest fitting host rule
    (null without one), the verdict (that rule's; else block when a glob of
    ``block_globs`` fits, else allow), and ``globs``, the fitting globs."""
    rules = tuple(sorted((tuple(r) for r in rules), key=lambda r: (-len(r[0] + r[1]), r)))
    globs = tuple(block_globs)

    @F.pandas_udf("struct<rule string, verdict string, globs string>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        auto = _compiled(rules, globs)
        names = [h + p for h, p, _ in rules]
        for urls in batches:
            found = auto.match(urls.tolist())
            by_rule, by_glob = found[:, :len(rules)], found[:, len(rules):]
            first = np.where(by_rule.any(axis=1), by_rule.argmax(axis=1), -1) if rules else np.full(len(urls), -1)
            blocked = by_glob.any(axis=1)
            yield pd.DataFrame({
                "rule": [names[k] if k >= 0 else None for k in first],
                "verdict": [rules[k][2] if k >= 0 else BLOCK if b else ALLOW for k, b in zip(first, blocked)],
                "globs": [",".join(globs[j] for j in np.flatnonzero(row)) for row in by_glob]})

    host, path = host_and_path(F.col("url"))
    return (df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
            .select("page_id", host.alias("host"), path.alias("path"))
            .withColumn("j", judge(F.concat(F.lit("."), "host", "path")))
            .select("page_id", "host", "path", "j.rule", "j.verdict", "j.globs"))
