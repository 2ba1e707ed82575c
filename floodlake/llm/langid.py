"""Language ID by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in windows of ``WINDOW``: a GRU from the left
and one from the right, whose states together label every byte position with
probabilities of the languages; the probabilities of all positions of a text
are averaged. Windows make the work of a text independent of its length and
let numpy run thousands of them side by side; every byte of every text is
read. Training is numpy backpropagation through time with Adam, on the
driver, from a bounded sample: at most ``DOCS`` documents of each language
and ``DRAWS`` windows of each, at places drawn by hash over the whole text.
The model (a few kB) travels with the tasks.

Defined cases: null text, or text without a letter, is ``und`` with score 0,
and so is everything when there was nothing to learn from; null languages are
not learned; texts of any length are read whole, a batch of windows at a
time; repeated rows are each labelled; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

WINDOW, HIDDEN = 64, 4
#: bounds of the training sample: documents of a language, windows of a document
DOCS, DRAWS = 800, 3
#: hexadecimal digits of the id hash by which a level of the sample's histogram counts, and its levels
DIGITS, LEVELS = 2, 2
EPOCHS, BATCH, RATE, SEED = 10, 128, 0.03, 5
#: windows computed side by side
BLOCK = 4096


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x


@dataclass
class ByteGru:
    """``table[d]``: (three gates, byte) input of the gates; ``back[d]``:
    (three gates, state); ``out``: (classes, both states and 1). Gates stand
    in the order update, reset, candidate; direction 0 reads from the left.
    Windows stand side by side in the last axis of every array."""
    table: list[np.ndarray]
    back: list[np.ndarray]
    out: np.ndarray
    classes: list[str]

    @staticmethod
    def fresh(classes: Sequence[str], hidden: int = HIDDEN, seed: int = SEED) -> ByteGru:
        rnd = np.random.default_rng(seed)
        draw = lambda *shape: rnd.normal(0, 0.3, shape).astype(np.float32)
        return ByteGru([draw(3 * hidden, 256) for _ in range(2)], [draw(3 * hidden, hidden) for _ in range(2)],
                       draw(len(classes), 2 * hidden + 1), list(classes))

    def states(self, windows: np.ndarray, keep: list | None = None) -> np.ndarray:
        """windows: (time, n) bytes -> (time, 2 hidden, n). ``keep`` collects
        what backpropagation needs."""
        steps, n = windows.shape
        k = self.back[0].shape[1]
        both = np.empty((steps, 2 * k, n), np.float32)
        for d in range(2):
            h = np.zeros((k, n), np.float32)
            trail = []
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                x = self.table[d].take(windows[t], axis=1)
                a = self.back[d] @ h
                x[:2 * k] += a[:2 * k]
                gates = _sigmoid(x[:2 * k])
                z, r = gates[:k], gates[k:]
                # tanh as a sigmoid, which numpy runs faster
                c = a[2 * k:] * r
                c += x[2 * k:]
                c *= 2
                _sigmoid(c)
                c *= 2
                c -= 1
                if keep is not None:
                    trail.append((t, h, a, z, r, c))
                h = h - c
                h *= z
                h += c
                both[t, d * k:(d + 1) * k] = h
            if keep is not None:
                keep.append(trail)
        return both

    def positions(self, windows: np.ndarray) -> np.ndarray:
        """(time, n) bytes -> (time, classes, n): probabilities at every position."""
        logits = np.matmul(self.out[:, :-1], self.states(windows))
        logits += self.out[:, -1:]
        for at in logits:
            _softmax(at)
        return logits

    def gradients(self, windows: np.ndarray, labels: np.ndarray, mask: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradients in the
        order of ``parameters``: backpropagation through time."""
        steps, n = windows.shape
        k = self.back[0].shape[1]
        trails: list = []
        s = self.states(windows, trails)
        p = np.matmul(self.out[:, :-1], s) + self.out[:, -1:]
        for at in p:
            _softmax(at)
        weight = (mask / max(mask.sum(), 1)).astype(np.float32)
        of = np.arange(n)
        loss = -float((weight * np.log(p[:, labels, of] + 1e-9)).sum())
        p[:, labels, of] -= 1
        p *= weight[:, None, :]
        d_out = np.hstack([np.einsum("tcn,tkn->ck", p, s, optimize=True), p.sum(axis=(0, 2))[:, None]])
        d_states = np.matmul(self.out[:, :-1].T, p)
        flat = windows.reshape(-1)
        order = np.argsort(flat, kind="stable")
        begins = np.flatnonzero(np.diff(flat[order], prepend=-1))
        grads: list[np.ndarray] = []
        for d in range(2):
            d_table, d_back = np.zeros_like(self.table[d]), np.zeros_like(self.back[d])
            dh = np.zeros((k, n), np.float32)
            d_x = np.empty((3 * k, steps, n), np.float32)
            da = np.empty((3 * k, n), np.float32)
            for t, h, a, z, r, c in reversed(trails[d]):
                dh = dh + d_states[t, d * k:(d + 1) * k]
                dc = dh * (1 - z) * (1 - c * c)
                da[:k] = dh * (h - c) * z * (1 - z)
                da[k:2 * k] = dc * a[2 * k:] * r * (1 - r)
                da[2 * k:] = dc
                d_x[:, t] = da
                da[2 * k:] *= r
                d_back += da @ h.T
                dh = dh * z + self.back[d].T @ da
            d_table[:, flat[order][begins]] = np.add.reduceat(d_x.reshape(3 * k, -1)[:, order], begins, axis=1)
            grads += [d_table, d_back]
        return loss, [*grads, d_out.astype(np.float32)]

    def parameters(self) -> list[np.ndarray]:
        return [self.table[0], self.back[0], self.table[1], self.back[1], self.out]

    def pooled(self, texts: Sequence[bytes]) -> np.ndarray:
        """Mean class probabilities over all bytes of every text."""
        total = np.zeros((len(texts), len(self.classes)))
        lens = np.array([len(t) for t in texts])
        pending: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        ready = 0

        def flush() -> None:
            w, who = np.concatenate(pending), np.concatenate(owner)
            for at in range(0, len(w), BLOCK):
                part = np.ascontiguousarray(w[at:at + BLOCK].T)
                p = self.positions(np.maximum(part, 0))
                p *= (part >= 0)[:, None, :]
                np.add.at(total, who[at:at + BLOCK], p.sum(axis=0).T)
            pending.clear()
            owner.clear()

        for i, t in enumerate(texts):
            # a long text goes block by block as well
            for at in range(0, len(t), WINDOW * BLOCK):
                w = cut_windows(t[at:at + WINDOW * BLOCK])
                pending.append(w)
                owner.append(np.full(len(w), i))
                ready += len(w)
                if ready >= BLOCK:
                    flush()
                    ready = 0
        if pending:
            flush()
        return total / np.maximum(lens, 1)[:, None]


def cut_windows(text: bytes, size: int = WINDOW) -> np.ndarray:
    """(n, size) bytes as small integers, -1 behind the end."""
    n = -(-len(text) // size)
    out = np.full(n * size, -1, np.int16)
    out[:len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, size)


def train(texts: Sequence[bytes], langs: Sequence[str], hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = SEED) -> ByteGru:
    """Fit to windows of text; every window is cut to ``WINDOW`` bytes by its caller."""
    classes = sorted(set(langs))
    net = ByteGru.fresh(classes, hidden, seed)
    x = np.vstack([cut_windows(t[:WINDOW]) for t in texts])
    y = np.array([classes.index(lang) for lang in langs])
    rnd = np.random.default_rng(seed)
    params = net.parameters()
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, steps = 0, epochs * -(-len(x) // BATCH)
    for _ in range(epochs):
        order = rnd.permutation(len(x))
        for at in range(0, len(x), BATCH):
            part = np.ascontiguousarray(x[order[at:at + BATCH]].T)
            _, grads = net.gradients(np.maximum(part, 0), y[order[at:at + BATCH]], part >= 0)
            norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
            step += 1
            rate = RATE * (1 - 0.9 * step / steps)
            for p, g, a, b in zip(params, grads, m, v):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= (rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return net


def _last_bucket(keyed: DataFrame, ends: DataFrame, level: int, per_lang: int) -> DataFrame:
    """Of each language the last bucket of ``level`` with fewer than
    ``per_lang`` ids before it, inside the bucket found one level above."""
    inner = keyed.select("lang", F.substring("bucket", 1, DIGITS * level).alias("part"))
    counts = inner.join(ends, "lang").where(F.col("part").startswith(F.col("end"))).groupBy("lang", "before", "part").count()
    below = F.sum("count").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return (counts.select("lang", "part", (F.col("before") + F.coalesce(below, F.lit(0))).alias("before"))
            .where(F.col("before") < per_lang).groupBy("lang")
            .agg(F.max("part").alias("end"), F.max("before").alias("before")))


def sample_windows(docs: DataFrame, text: str = "text", lang: str = "lang", ident: str = "doc_id", per_lang: int = DOCS,
                   draws: int = DRAWS) -> list[tuple[str, bytes]]:
    """(language, window) of the training sample, in a fixed order: the
    documents of smallest id hash of each language, windows at hashed places.
    Rows of one language and id count as one document, with the windows that
    sort first."""
    t, key = F.col("text"), F.md5(F.col("ident").cast("string"))
    src = (docs.select(F.col(f"`{ident}`").alias("ident"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
           .where("ident is not null and lang is not null and text is not null"))
    # a histogram of the hashes tells where each language's sample ends, so only ids up to there are ranked
    ids = cut_lineage(src.select("ident", "lang").distinct(), "langid_ids")
    keyed = ids.select("ident", "lang", key.alias("key"), F.substring(key, 1, DIGITS * LEVELS).alias("bucket"))
    ends = ids.select("lang").distinct().select("lang", F.lit("").alias("end"), F.lit(0).cast("long").alias("before"))
    for level in range(1, LEVELS + 1):      # each level cuts the bucket in which the sample ends
        ends = cut_lineage(_last_bucket(keyed, ends, level, per_lang), "langid_ends")
    best = (keyed.join(ends, "lang").where("bucket <= end")
            .withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("key", "ident"))).where(F.col("n") <= per_lang))
    at = lambda k: 1 + F.pmod(F.xxhash64("ident", F.lit(k)), F.greatest(F.length(t) - WINDOW + 1, F.lit(1))).cast("int")
    # at most per_lang ids of a language: small enough to broadcast, so the rows of a common id are reduced where they are read
    rows = (src.join(F.broadcast(best.select("lang", "ident", "key")), ["lang", "ident"])
            .groupBy("lang", "key").agg(F.min(F.array(*[F.substring(t, at(k), F.lit(WINDOW)) for k in range(draws)])).alias("windows"))
            .select("lang", "key", F.posexplode("windows"))
            .orderBy("lang", "key", "pos", "col").collect())
    return [(r["lang"], r["col"].encode("utf-8")[:WINDOW]) for r in rows if r["col"]]


def predict(docs: DataFrame, net: ByteGru | None, text: str = "text") -> Column:
    """struct<lang_pred, score> of the text column."""
    @F.pandas_udf("struct<lang_pred string, score double>")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            p = net.pooled([t.encode("utf-8") if t else b"" for t in texts])
            best = p.argmax(axis=1)
            yield pd.DataFrame({"lang_pred": [net.classes[k] for k in best],
                                "score": np.clip(p[np.arange(len(best)), best], 0.0, 1.0)})

    none = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    if net is None:
        return none
    t = F.col(f"`{text}`")
    return F.when(F.coalesce(t, F.lit("")).rlike(r"\p{L}"), label(t)).otherwise(none)


def identify(docs: DataFrame, learn: Column, ident: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, lang_pred, score of every row; learns from the rows where ``learn``."""
    sample = sample_windows(docs.where(learn), text, lang, ident)
    net = train([w for _, w in sample], [lang for lang, _ in sample]) if sample else None
    return docs.select(F.col(f"`{ident}`").alias("doc_id"), predict(docs, net, text).alias("p")).select("doc_id", "p.*")
