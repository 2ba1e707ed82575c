"""Quality classifier: a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad. Its features are counts of the
line and of its two neighbours (how long, how much of it is capitals, digits,
table bars, symbols, exclamation marks; how varied its words; whether the
line stood in the text before), so a label sees its surroundings twice: by
features and by the transitions of the chain. The field is trained in numpy
on runs of at most ``RUN`` lines, whose lines all carry their document's
label, by gradient ascent on the exact conditional likelihood
(forward-backward gives the expected counts). A document's score is the mean
of its lines' forward-backward marginals, weighted by line length.

The sample is bounded: the ``DOCS`` labelled documents of smallest id hash,
drawn by their ids alone, and the ``RUNS`` runs of smallest hash among theirs,
features only (at most RUNS x RUN x 20 numbers). Scoring
reads whole texts, each chain in full.

With two labels a message of the chain is one number, the log-odds, and all
documents of a batch advance together.

Defined cases: null and empty texts are one empty line; a line of any length
is one line; documents without labels don't train; without any label, or with
one label only, the score is that label's share (0.5 with none); repeated
rows and ties are each scored alike; an empty table gives an empty result; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

#: bounds of the training sample: documents, runs of them, and lines of a run
DOCS, RUNS, RUN = 3000, 8000, 32
STEPS, RATE, DECAY = 250, 0.1, 2e-4
#: lines scored side by side in a Python worker, unless one text has more
LINES = 50_000

_ALL = bytes(range(256))
_GROUPS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "bar": b"|",
    "symbol": b"#*$%&<>", "bang": b"!", "stop": b".,;:?", "code": b"{}[]()=/\\_@+~^`\"'-", "high": bytes(range(128, 256)),
}
_DROP = {name: bytes(set(_ALL) - set(group)) for name, group in _GROUPS.items()}
N_LINE = len(_GROUPS) + 8


def line_features(line: bytes, seen: bool) -> list[float]:
    n = len(line) or 1
    words = line.split()
    k = len(words) or 1
    shares = [len(line.translate(None, drop)) / n for drop in _DROP.values()]
    return [*shares, np.log1p(len(line)), np.log1p(len(words)), min((n - k) / k, 20.0) / 10, len(set(words)) / k,
            float(seen), float(not words), sum(map(bytes.isupper, words)) / k, float(line[-1:] in (b".", b"!", b"?"))]


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines, N_LINE) features and the line lengths of one text."""
    lines = (text or "").encode("utf-8").split(b"\n")
    seen: set[bytes] = set()
    rows = []
    for line in lines:
        rows.append(line_features(line, line in seen and bool(line.strip())))
        seen.add(line)
    return np.array(rows, np.float32), np.array([len(x) for x in lines], np.float64)


def with_neighbours(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Features of every line, its predecessor and its successor (zero at the
    ends of a text), and marks for the ends."""
    before, after = np.roll(x, 1, axis=0), np.roll(x, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.hstack([x, before, after, first[:, None], last[:, None], np.ones((len(x), 1), x.dtype)]).astype(np.float32)


def _carry(odds: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log-odds sent on through the transitions ``t`` (2 x 2, from x to)."""
    return np.logaddexp(odds + t[1, 1], t[0, 1]) - np.logaddexp(odds + t[1, 0], t[0, 0])


def forward_backward(emit: np.ndarray, lens: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For chains laid one after the other: ``a``, the log-odds of the prefix
    with the line itself, and ``b``, those of the suffix behind it."""
    start = np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64)
    order = np.argsort(-lens, kind="stable")
    start, ends, lens = start[order], (start + lens)[order], lens[order]
    a, b = emit.astype(np.float64), np.zeros(len(emit))
    live = len(lens)
    for step in range(1, int(lens[0]) if len(lens) else 0):
        while lens[live - 1] <= step:
            live -= 1
        at = start[:live] + step
        a[at] += _carry(a[at - 1], t)
        at = ends[:live] - 1 - step
        b[at] = _carry(emit[at + 1] + b[at + 1], t.T)
    return a, b


@dataclass
class LineField:
    """Weights of the features (for good against bad), transitions, scaling."""
    w: np.ndarray
    t: np.ndarray
    mean: np.ndarray
    std: np.ndarray

    def marginals(self, x: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """P(good) of every line; x: scaled features with neighbours."""
        a, b = forward_backward(x @ self.w, lens, self.t)
        return 1 / (1 + np.exp(-np.clip(a + b, -60, 60)))

    def prepare(self, feats: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        lens = np.array([len(f) for f in feats], np.int64)
        first = np.zeros(int(lens.sum()), bool)
        last = first.copy()
        ends = np.cumsum(lens)
        first[ends - lens], last[ends - 1] = True, True
        return with_neighbours((np.vstack(feats) - self.mean) / self.std, first, last), lens

    def score(self, texts: Iterable[str | None], lines: int = LINES) -> np.ndarray:
        """Length-weighted mean marginal of every text. Texts are taken
        together up to ``lines`` lines, a longer text by itself."""
        out, held, count = [], [], 0
        for found in map(text_features, texts):
            if held and count + len(found[0]) > lines:
                out.append(self._means(held))
                held, count = [], 0
            held.append(found)
            count += len(found[0])
        return np.concatenate([*out, self._means(held)]) if held else np.zeros(0)

    def _means(self, found: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        feats, sizes = zip(*found)
        x, lens = self.prepare(feats)
        p = self.marginals(x, lens)
        weight = np.concatenate(sizes) + 1
        begins = np.cumsum(lens) - lens
        return np.add.reduceat(p * weight, begins) / np.add.reduceat(weight, begins)


def train(runs: Sequence[tuple[np.ndarray, int]], steps: int = STEPS) -> LineField:
    """Fit to (line features, label) runs by Adam on the mean log-likelihood."""
    lines = np.vstack([f for f, _ in runs])
    field = LineField(np.zeros(3 * N_LINE + 3, np.float32), np.zeros((2, 2)), lines.mean(axis=0), lines.std(axis=0) + 1e-3)
    x, lens = field.prepare([f for f, _ in runs])
    y = np.repeat(np.array([label for _, label in runs], np.float64), lens)
    inner = np.ones(len(y), bool)
    inner[np.cumsum(lens) - 1] = False      # lines with a successor in their run
    pairs = np.flatnonzero(inner)
    want = np.array([[((y[pairs] == i) & (y[pairs + 1] == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    state = np.zeros((2, len(field.w) + 4))
    for step in range(1, steps + 1):
        emit = x @ field.w
        a, b = forward_backward(emit, lens, field.t)
        p = 1 / (1 + np.exp(-np.clip(a + b, -60, 60)))
        left, right = a[pairs], (emit + b)[pairs + 1]
        joint = np.stack([field.t[i, j] + left * i + right * j for i in (0, 1) for j in (0, 1)])
        joint -= joint.max(axis=0)
        joint = np.exp(joint)
        joint /= joint.sum(axis=0)
        grad = np.concatenate([x.T @ (y - p), (want - joint.sum(axis=1).reshape(2, 2)).ravel()]) / len(lens)
        params = np.concatenate([field.w, field.t.ravel()])
        grad -= DECAY * params
        state[0] += 0.1 * (grad - state[0])
        state[1] += 0.001 * (grad * grad - state[1])
        params = params + RATE * (1 - 0.9 * step / steps) * (state[0] / (1 - 0.9 ** step)) / (
            np.sqrt(state[1] / (1 - 0.999 ** step)) + 1e-8)
        field.w, field.t = params[:-4].astype(np.float32), params[-4:].reshape(2, 2)
    return field


def sample_runs(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "quality",
                docs_bound: int = DOCS, runs: int = RUNS) -> list[tuple[np.ndarray, int]]:
    """The training sample: runs of lines with their document's label."""
    @F.pandas_udf("array<struct<k int, x binary>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                x, _ = text_features(t)
                out.append([{"k": k, "x": x[at:at + RUN].tobytes()} for k, at in enumerate(range(0, len(x), RUN))])
            yield pd.Series(out)

    marked = labels.select(F.col(f"`{ident}`").alias("i"), F.col(f"`{label}`").cast("int").alias("y")).where("y in (0, 1)")
    src = docs.select(F.col(f"`{ident}`").alias("i"), F.col(f"`{text}`").alias("text"))
    # draw by id first: a bounded, written table, so the texts of all others stay where they are
    drawn = cut_lineage(src.select("i").join(marked, "i").orderBy(F.md5(F.col("i").cast("string")), "i", "y").limit(docs_bound)
                        .distinct(), "crf_sample")
    rows = (src.join(F.broadcast(drawn), "i").select("i", "y", F.explode(cut("text")).alias("r"))
            .select("y", "r.x", F.md5(F.concat_ws("/", F.col("i").cast("string"), F.col("r.k").cast("string"))).alias("key"))
            .orderBy("key", "y", "x").limit(runs).collect())
    return [(np.frombuffer(r["x"], np.float32).reshape(-1, N_LINE), r["y"]) for r in rows]


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column, ident: str = "doc_id", text: str = "text",
                  label: str = "quality") -> DataFrame:
    """doc_id and score of every row; learns from the labelled rows where ``learn``."""
    runs = sample_runs(docs.where(learn), labels, ident, text, label)
    marks = {y for _, y in runs}
    if len(marks) < 2:
        only = F.lit(0.5 if not marks else float(marks.pop()))
        return docs.select(F.col(f"`{ident}`").alias("doc_id"), only.alias("score"))
    field = train(runs)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.clip(field.score(texts.tolist()), 0.0, 1.0))

    return docs.select(F.col(f"`{ident}`").alias("doc_id"), score(F.col(f"`{text}`")).alias("score"))
