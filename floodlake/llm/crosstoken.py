"""Cross-tokenizer alignment by an associative fragment monoid.

Two tokenizers cut the same bytes (a blank and the text). Offsets where a
token of A and a token of B both end cut the bytes into groups; tokens whose
byte ranges overlap are linked.

``Fragment`` is what any byte range contributes: an open prefix (tokens that
end in the range up to its first common end), closed groups, and an open
suffix (tokens behind its last common end). Two neighbouring fragments
compose by closing the group of the left one's suffix and the right one's
prefix; that is associative, so the fragments of a text may be composed in
any tree.

- Both tokenizers always end a token before a blank that follows a character
  which is not white space (A splits there before it merges; no piece of B
  holds a blank behind anything else). The stretch between two such places, a
  "unit", is a fragment with nothing open, the same wherever it stands: units
  are aligned once and kept in a bounded table, and a text's fragment is the
  row of its units'.
- Texts above ``LONG`` bytes are cut into byte ranges of ``CHUNK``, wherever
  these fall; the ranges become rows (with the units that their edges cut),
  are spread over tasks, and their fragments are reduced ``FAN`` at a time.
  Only a unit above ``CHUNK`` bytes is not cut, since merges run through it.

Links are counted over the corpus without moving a row per link. Texts are
gathered to blocks; a block keeps each text's links as places in a list of
its distinct pairs (frequent pairs first, packed as differences) and sends
the list with the number of texts that hold each pair. The lists are summed
to corpus counts, and the counts go back to each block's list; a pair comes
once per block however often it occurs.

Defined cases: null and empty texts have no tokens, and neither have texts
that a tokenizer does not give back byte for byte (a literal U+2581); all
their columns are zero and ``groups_sha256`` is ''. Rows that repeat, share
an id or have none are texts of their own. An empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

#: bytes of a text that is cut into ranges, and of a range
LONG, CHUNK = 1 << 16, 1 << 15
#: fragments composed by one task in one step
FAN = 32
#: units kept in a Python worker; longer ones are not kept beyond their rows
KEEP, LONG_UNIT = 250_000, 64
#: texts tokenized at a time; texts and (text, pair) entries of a block
ROWS, BLOCK_ROWS, BLOCK_ENTRIES = 400, 8192, 1_500_000
#: new units that the tokenizers get as one string
TOGETHER = 2000

_CUT = re.compile(r"(?<=\S)(?= )")
_ODD = re.compile(r"\s ")


def _byte_of_char() -> dict[str, int]:
    """The printable characters by which a byte-level vocabulary writes bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """The two vocabularies: ids of units, bytes of tokens."""

    def __init__(self, a_json: bytes, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark runs a task on every core already
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(a_json.decode("utf-8"))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b_model)
        chars = _byte_of_char()
        names = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, k in names.items():
            self.a_bytes[k] = bytes(chars[c] for c in name)
        self.b_bytes = []
        for k in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(k)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode("utf-8"))
        self.a_len, self.b_len = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.blank = self.b.piece_to_id("▁")
        # a token's decimal id with what follows it
        self.name = {sep: [b"%d%s" % (k, sep) for k in range(max(len(self.a_bytes), len(self.b_bytes)))] for sep in (b",", b"|", b";")}

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of units, which all start with the blank that B adds itself."""
        a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        b = self.b.encode([u[1:] for u in units], num_threads=1)
        return a, [ids if u != " " else [self.blank] for u, ids in zip(units, b)]

    def same(self, unit: str, a: list[int], b: list[int]) -> bool:
        data = unit.encode("utf-8")
        return b"".join([self.a_bytes[x] for x in a]) == data and b"".join([self.b_bytes[x] for x in b]) == data

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For tokens of the same bytes: the ends of A's and B's tokens, the
        common ones, and every overlapping pair with the byte where it starts."""
        a_ends, b_ends = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        # the bytes between two neighbouring starts lie in one token of each side, and no other such stretch in the same two
        starts = np.union1d(np.r_[0, a_ends[:-1]], np.r_[0, b_ends[:-1]]) if len(a) else np.zeros(0, np.int64)
        at_a, at_b = np.searchsorted(a_ends, starts, "right"), np.searchsorted(b_ends, starts, "right")
        pairs = a[at_a] * len(self.b_bytes) + b[at_b]
        return a_ends, b_ends, cuts, pairs, starts

    def spell(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, cuts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The groups as decimal ids, one string per token, in order (A's
        tokens of a group, then B's), and the group of each string."""
        a_group, b_group = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
        group = np.r_[a_group, b_group]
        order = np.argsort(np.r_[2 * a_group, 2 * b_group + 1], kind="stable")
        comma, bar, semi = self.name[b","], self.name[b"|"], self.name[b";"]
        names = [bar[x] if end else comma[x] for x, end in zip(a.tolist(), np.isin(a_ends, cuts).tolist())]
        names += [semi[x] if end else comma[x] for x, end in zip(b.tolist(), np.isin(b_ends, cuts).tolist())]
        return [names[k] for k in order.tolist()], group[order]


_NONE = np.zeros(0, np.int64)


@dataclass
class Fragment:
    """What a byte range knows of the alignment. ``cut``: it holds a common
    end; without one all its tokens are in the head."""
    cut: bool = False
    head: tuple = (_NONE, _NONE)
    text: bytes = b""
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    pairs: np.ndarray = field(default_factory=lambda: _NONE)
    tail: tuple = (_NONE, _NONE)
    bad: bool = False


def _join(x: tuple, y: tuple) -> tuple:
    return np.r_[x[0], y[0]], np.r_[x[1], y[1]]


def compose(tok: Tokenizers, left: Fragment, right: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges; associative, ``Fragment()`` is neutral."""
    if left.bad or right.bad:
        return Fragment(bad=True)
    if not left.cut and not right.cut:
        return Fragment(False, _join(left.head, right.head))
    if not left.cut:
        return Fragment(True, _join(left.head, right.head), right.text, right.n_a, right.n_b, right.n_groups, right.pairs, right.tail)
    if not right.cut:
        return Fragment(True, left.head, left.text, left.n_a, left.n_b, left.n_groups, left.pairs, _join(left.tail, right.head))
    a, b = _join(left.tail, right.head)
    parts, pairs = [left.text], [left.pairs]
    if len(a):
        a_ends, b_ends, cuts, closed, _ = tok.align(a, b)
        parts.append(b"".join(tok.spell(a, b, a_ends, b_ends, cuts)[0])[:-1])
        pairs.append(closed)
    parts.append(right.text)
    return Fragment(True, left.head, b";".join(p for p in parts if p), left.n_a + len(a) + right.n_a, left.n_b + len(b) + right.n_b,
                    left.n_groups + (len(a) > 0) + right.n_groups, np.concatenate([*pairs, right.pairs]), right.tail)


def fragment(tok: Tokenizers, a: np.ndarray, b: np.ndarray, low: int, high: int, starts: bool) -> Fragment:
    """The fragment of the bytes behind ``low`` up to ``high`` of the tokens
    a and b. ``starts``: ``low`` is the start of the text, which is a cut."""
    a_ends, b_ends, cuts, _, _ = tok.align(a, b)
    mine_a, mine_b = (a_ends > low) & (a_ends <= high), (b_ends > low) & (b_ends <= high)
    cuts = cuts[(cuts > low) & (cuts <= high)]
    if starts:
        cuts = np.r_[low, cuts]
    if not len(cuts):
        return Fragment(False, (a[mine_a], b[mine_b]))
    first, last = cuts[0], cuts[-1]
    inner_a, inner_b = (a_ends > first) & (a_ends <= last), (b_ends > first) & (b_ends <= last)
    ia, ib = a[inner_a], b[inner_b]
    e = tok.align(ia, ib)
    return Fragment(True, (a[mine_a & (a_ends <= first)], b[mine_b & (b_ends <= first)]), b"".join(tok.spell(ia, ib, *e[:3])[0])[:-1],
                    len(ia), len(ib), len(e[2]), e[3], (a[mine_a & (a_ends > last)], b[mine_b & (b_ends > last)]))


class Units:
    """Aligned units, kept by use: beyond ``KEEP`` the less used half goes."""

    def __init__(self, tok: Tokenizers):
        self.tok = tok
        self.at: dict[str, int] = {}
        self.texts: list[bytes] = []
        self.stats = np.zeros((0, 3), np.int64)     # n_a, n_b, n_groups; -1 where the bytes differ
        self.pairs, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.uses = np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    @staticmethod
    def split(text: str) -> list[str]:
        """The units of a text with its leading blank."""
        text = " " + text
        if _ODD.search(text):
            return _CUT.split(text)
        return [" " + x for x in text[1:].split(" ")]

    def _learn(self, units: list[str]) -> None:
        """New units: those that may stand before another one go through the
        tokenizers in long strings (their borders are token ends there as
        everywhere), the others one by one."""
        # behind white space the next unit's blank is no safe place
        plain = [u for u in units if not u[-1].isspace()]
        alone = [u for u in units if u[-1].isspace()]
        for low in range(0, len(plain), TOGETHER):
            some = plain[low:low + TOGETHER]
            row = "".join(some)
            (a,), (b,) = self.tok.encode([row])
            if self.tok.same(row, a, b):
                self._keep(some, np.array(a, np.int64), np.array(b, np.int64), np.cumsum([len(u.encode("utf-8")) for u in some]))
            else:
                alone += some
        if alone:
            ids_a, ids_b = self.tok.encode(alone)
            good = [self.tok.same(u, x, y) for u, x, y in zip(alone, ids_a, ids_b)]
            kept = [(u, x, y) for u, x, y, g in zip(alone, ids_a, ids_b, good) if g]
            if kept:
                self._keep([u for u, _, _ in kept], np.array([t for _, x, _ in kept for t in x], np.int64),
                           np.array([t for _, _, y in kept for t in y], np.int64), np.cumsum([len(u.encode("utf-8")) for u, _, _ in kept]))
            for u, g in zip(alone, good):
                if not g:
                    self._add([u], [b""], np.full((1, 3), -1), np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def _keep(self, units: list[str], a: np.ndarray, b: np.ndarray, borders: np.ndarray) -> None:
        """Align units as one row of bytes and take the row apart at their borders."""
        a_ends, b_ends, cuts, pairs, starts = self.tok.align(a, b)
        names, group = self.tok.spell(a, b, a_ends, b_ends, cuts)
        groups = np.searchsorted(cuts, borders) + 1         # so many up to the end of each unit
        to_name = np.searchsorted(group, groups).tolist()
        texts = [b"".join(names[low:high])[:-1] for low, high in zip([0, *to_name], to_name)]
        counts = [np.diff(x, prepend=0) for x in (np.searchsorted(a_ends, borders, "right"), np.searchsorted(b_ends, borders, "right"), groups)]
        self._add(units, texts, np.stack(counts, axis=1), pairs.astype(np.uint32), np.diff(np.searchsorted(starts, borders), prepend=0))

    def _add(self, units: list[str], texts: list[bytes], stats: np.ndarray, pairs: np.ndarray, lengths: np.ndarray) -> None:
        self.at.update(zip(units, range(len(self.at), len(self.at) + len(units))))
        self.texts += texts
        self.new.append((stats, pairs, lengths))

    def _settle(self) -> None:
        """Add what was learnt to the arrays."""
        stats, pairs, lengths = zip(*self.new)
        self.stats, self.pairs = np.concatenate([self.stats, *stats]), np.concatenate([self.pairs, *pairs])
        self.begin = np.r_[self.begin, self.begin[-1] + np.cumsum(np.concatenate(lengths))].astype(np.int64)
        self.uses = np.r_[self.uses, np.zeros(len(self.at) - len(self.uses), np.int64)]
        self.new = []

    def look(self, units: list[str]) -> np.ndarray:
        """The places of units; new ones are aligned first."""
        if len(self.at) >= KEEP:
            self._forget()
        places = list(map(self.at.get, units))
        if None in places:
            self._learn(list({u for u, p in zip(units, places) if p is None}))
            self._settle()
            places = list(map(self.at.__getitem__, units))
        out = np.array(places, np.int64)
        self.uses += np.bincount(out, minlength=len(self.uses))
        return out

    def _forget(self) -> None:
        floor = np.partition(self.uses, len(self.uses) - KEEP // 2)[len(self.uses) - KEEP // 2]
        stay = [(u, k) for u, k in self.at.items() if self.uses[k] >= floor and len(u) <= LONG_UNIT][-KEEP // 2:]
        old = np.array([k for _, k in stay], np.int64)
        self.at = {u: k for k, (u, _) in enumerate(stay)}
        self.texts = [self.texts[k] for k in old.tolist()]
        lengths = (self.begin[1:] - self.begin[:-1])[old]
        self.pairs = self.pairs[_ranges(self.begin[old], lengths)]
        self.begin = np.r_[0, np.cumsum(lengths)].astype(np.int64)
        self.stats, self.uses = self.stats[old], self.uses[old] // 2


def _ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[k], begin[k] + 1, ... (length[k] of them), one range after another."""
    ends = np.cumsum(length)
    return np.repeat(begin - np.r_[0, ends[:-1]], length) + np.arange(ends[-1] if len(ends) else 0)


def _pack(values: np.ndarray) -> bytes:
    """Small non-negative numbers: a byte each, those from 255 on behind them."""
    small = np.minimum(values, 255).astype(np.uint8)
    return small.tobytes() + values[values >= 255].astype("<u4").tobytes()


def _unpack(data: bytes, n: int) -> tuple[np.ndarray, int]:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    more = np.flatnonzero(out == 255)
    out[more] = np.frombuffer(data, "<u4", len(more), n)
    return out, n + 4 * len(more)


class Block:
    """Texts and their links, until the block is sent."""

    def __init__(self, number: int, id_type: pa.DataType):
        self.number, self.id_type = number, id_type
        self._empty()

    def _empty(self) -> None:
        self.rows: list[tuple] = []
        self.entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []      # text, pair, times
        self.n = 0

    def add(self, rows: list[tuple], text: np.ndarray, pair: np.ndarray, times: np.ndarray) -> None:
        """Rows of doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the
        links of each: every (text, pair) once, with how often it occurs."""
        self.entries.append((text + len(self.rows), pair, times))
        self.rows += rows
        self.n += len(pair)

    def full(self) -> bool:
        return len(self.rows) >= BLOCK_ROWS or self.n >= BLOCK_ENTRIES

    def send(self) -> pa.RecordBatch:
        """One row per text, and one with the block's distinct pairs, those of most texts first."""
        text, pair, times = (np.concatenate(c).astype(np.int64) for c in zip(*self.entries))
        distinct, place, docs = np.unique(pair, return_inverse=True, return_counts=True)
        order = np.argsort(-docs, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        key = text << 32 | rank[place]
        sorter = np.argsort(key, kind="stable")
        key, times = key[sorter], times[sorter]
        ends = np.searchsorted(key >> 32, np.arange(len(self.rows)), "right")
        links, low = [], 0
        for end in ends.tolist():
            links.append(_pack(np.diff(key[low:end] & 0xFFFFFFFF, prepend=0)) + _pack(times[low:end]))
            low = end
        n = len(self.rows)
        ids, *numbers, digests = zip(*self.rows)
        out = pa.RecordBatch.from_arrays([
            pa.array([self.number] * (n + 1), pa.int64()), pa.array([*ids, None], self.id_type),
            *[pa.array([*c, None], pa.int64()) for c in numbers], pa.array([*digests, None], pa.string()),
            pa.array([*np.diff(ends, prepend=0).tolist(), None], pa.int32()), pa.array([*links, None], pa.binary()),
            pa.array([None] * n + [distinct[order]], pa.list_(pa.int64())), pa.array([None] * n + [docs[order]], pa.list_(pa.int64()))],
            names=["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "size", "links", "pairs", "docs"])
        self.number += 1
        self._empty()
        return out


@lru_cache(maxsize=1)
def _tokenizers(a_json: bytes, b_model: bytes) -> Tokenizers:
    return Tokenizers(a_json, b_model)


@lru_cache(maxsize=1)
def _units(a_json: bytes, b_model: bytes) -> Units:
    return Units(_tokenizers(a_json, b_model))


def _sum_equal(text: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every (text, pair) once, with its times summed."""
    key = text.astype(np.int64) << 32 | pair.astype(np.int64)
    order = np.argsort(key)
    key = key[order]
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else _NONE
    return key[begin] >> 32, key[begin] & 0xFFFFFFFF, np.add.reduceat(times[order], begin) if len(key) else _NONE


def _row(ident, n_a: int, n_b: int, n_groups: int, digest: str) -> tuple:
    return ident, n_a, n_b, n_groups, n_a + n_b - n_groups, digest


def _few(texts: list[str | None]) -> Iterator[slice]:
    """Slices of a batch of at most ``ROWS`` texts and little over ``LONG`` * 32 characters."""
    low, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if k - low + 1 >= ROWS or size >= LONG * 32 or k == len(texts) - 1:
            yield slice(low, k + 1)
            low, size = k + 1, 0


def _whole(units: Units, ids: list, texts: list[str | None], block: Block) -> None:
    """Texts as rows of units."""
    split = [units.split(t) if t else [] for t in texts]
    places = units.look([u for s in split for u in s])
    sizes = np.array([len(s) for s in split], np.int64)
    text = np.repeat(np.arange(len(split)), sizes)
    stats = units.stats[places]
    bad = np.bincount(text, weights=stats[:, 0] < 0, minlength=len(split)) > 0
    sums = [np.bincount(text, weights=stats[:, k], minlength=len(split)).astype(np.int64).tolist() for k in range(3)]
    rows, low, listed = [], 0, places.tolist()
    for k, (ident, size) in enumerate(zip(ids, sizes.tolist())):
        if size and not bad[k]:
            spelled = b";".join(map(units.texts.__getitem__, listed[low:low + size]))
            rows.append(_row(ident, sums[0][k], sums[1][k], sums[2][k], hashlib.sha256(spelled).hexdigest()))
        else:
            rows.append(_row(ident, 0, 0, 0, ""))
        low += size
    good = ~bad[text]
    key, times = np.unique(text[good] << 32 | places[good], return_counts=True)
    text, place = key >> 32, key & 0xFFFFFFFF
    n = units.begin[place + 1] - units.begin[place]
    block.add(rows, *_sum_equal(np.repeat(text, n), units.pairs[_ranges(units.begin[place], n)], np.repeat(times, n)))


def byte_ranges(data: bytes, chunk: int) -> Iterator[tuple[int, int, bytes]]:
    """The ranges of a text (with its leading blank): the bytes of the units
    that a range touches, and where in them it begins and ends. An edge in a
    unit longer than a range is left out."""
    x = np.frombuffer(data, np.uint8)
    units = np.r_[0, np.flatnonzero((x[1:] == 32) & (x[:-1] > 32) & (x[:-1] < 127)) + 1, len(x)]
    edges = np.arange(chunk, len(x), chunk)
    k = np.searchsorted(units, edges, "right")
    edges = np.r_[0, edges[units[k] - units[k - 1] <= chunk], len(x)]
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
        begin, end = int(units[np.searchsorted(units, low, "right") - 1]), int(units[np.searchsorted(units, high, "left")])
        yield low - begin, high - begin, data[begin:end]


_FRAGMENT = ("cut boolean, bad boolean, n_a long, n_b long, n_groups long, text binary, pairs binary, "
             "head_a binary, head_b binary, tail_a binary, tail_b binary")
_FRAGMENT_ARROW = (pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 6)


def _write(f: Fragment) -> tuple:
    ids = lambda x: x.astype("<u4").tobytes()
    return f.cut, f.bad, f.n_a, f.n_b, f.n_groups, f.text, ids(f.pairs), ids(f.head[0]), ids(f.head[1]), ids(f.tail[0]), ids(f.tail[1])


def _read(row: tuple) -> Fragment:
    cut, bad, n_a, n_b, n_groups, text, *ids = row
    pairs, head_a, head_b, tail_a, tail_b = (np.frombuffer(x, "<u4").astype(np.int64) for x in ids)
    return Fragment(cut, (head_a, head_b), text, n_a, n_b, n_groups, pairs, (tail_a, tail_b), bad)


def range_fragment(tok: Tokenizers, text: str, low: int, high: int, starts: bool) -> Fragment:
    """The fragment of a byte range within the units ``text``."""
    units = Units.split(text[1:])
    distinct = list(dict.fromkeys(units))
    a, b = tok.encode(distinct)
    if not all(map(tok.same, distinct, a, b)):
        return Fragment(bad=True)
    at = {u: k for k, u in enumerate(distinct)}
    flat = lambda ids: np.array([t for u in units for t in ids[at[u]]], np.int64)
    return fragment(tok, flat(a), flat(b), low, high, starts)


def _long_texts(src: DataFrame, files, long: int, chunk: int, fan: int) -> DataFrame:
    """id and fragment of every long text: cut to ranges, spread, reduced."""
    kind = src.schema["doc_id"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for ident, text in zip(batch.column(0), batch.column(1)):
                for seq, (low, high, data) in enumerate(byte_ranges(b" " + text.as_py().encode("utf-8"), chunk)):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([ident.as_py()], batch.schema.field(0).type), pa.array([uid]), pa.array([seq]), pa.array([low]), pa.array([high]),
                        pa.array([data.decode("utf-8")])], names=["doc_id", "uid", "seq", "low", "high", "text"])
                uid += 1
    head = f"doc_id {kind.simpleString()}, uid long, seq long"
    ranges = cut_lineage(src.where(F.octet_length("text") > long).mapInArrow(cut, head + ", low long, high long, text string"), "align_ranges")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizers(*files.value)
        for batch in batches:
            for k in range(batch.num_rows):
                seq, low, high, text = (batch.column(c)[k].as_py() for c in range(2, 6))
                made = _write(range_fragment(tok, text, low, high, seq == 0))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in range(3)),
                                                  *(pa.array([x], t) for x, t in zip(made, _FRAGMENT_ARROW))], names=names)
    names = [c.split()[0] for c in (head + ", " + _FRAGMENT).split(", ")]
    level = cut_lineage(ranges.repartition(F.col("uid"), F.col("seq")).mapInArrow(build, head + ", " + _FRAGMENT), "align_fragments")

    def reduce(rows: pa.Table) -> pa.Table:
        tok = _tokenizers(*files.value)
        rows = rows.sort_by("seq")
        out = Fragment()
        for row in zip(*(rows.column(c).to_pylist() for c in range(3, 3 + len(_FRAGMENT_ARROW)))):
            out = compose(tok, out, _read(row))
        return pa.Table.from_arrays([rows.column(0).slice(0, 1), rows.column(1).slice(0, 1), pa.array([rows["seq"][0].as_py() // fan]),
                                     *(pa.array([x], t) for x, t in zip(_write(out), _FRAGMENT_ARROW))], names=names)
    while (level.agg(F.max("seq")).first()[0] or 0) > 0:
        level = cut_lineage(level.groupBy("uid", F.floor(F.col("seq") / fan)).applyInArrow(reduce, head + ", " + _FRAGMENT), "align_fragments")
    return level


def _file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def align(docs: DataFrame, a_path: str, b_path: str, ident: str = "doc_id", text: str = "text", long: int = LONG, chunk: int = CHUNK,
          fan: int = FAN) -> DataFrame:
    """One row per text: doc_id, n_a, n_b, n_groups, n_links, groups_sha256,
    n_best, count_sum. The vocabulary files (below 3 MB) are read by the
    driver and sent along."""
    vocabularies = tuple(_file(p) for p in (a_path, b_path))
    files = docs.sparkSession.sparkContext.broadcast(vocabularies)
    src = docs.select(F.col(f"`{ident}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    columns = (f"block long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
               "size int, links binary, pairs array<bigint>, docs array<bigint>")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, block = _units(*files.value), None
        for batch in batches:
            block = block or Block(TaskContext.get().partitionId() << 24, batch.schema.field(0).type)
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in _few(texts):
                _whole(units, ids[part], texts[part], block)
                if block.full():
                    yield block.send()
        if block and block.rows:
            yield block.send()

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            block = block or Block(-(TaskContext.get().partitionId() + 1) << 24, batch.schema.field(0).type)
            for ident, *row in zip(*(c.to_pylist() for c in batch.columns)):
                f = _read(row)
                digest = "" if f.bad else hashlib.sha256(f.text).hexdigest()
                block.add([_row(ident, f.n_a, f.n_b, f.n_groups, digest)],
                          *_sum_equal(np.zeros(len(f.pairs), np.int64), f.pairs, np.ones(len(f.pairs), np.int64)))
                if block.full():
                    yield block.send()
        if block and block.rows:
            yield block.send()
    short = src.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= long).mapInArrow(whole, columns)
    far = _long_texts(src, files, long, chunk, fan).drop("uid", "seq").mapInArrow(reduced, columns)
    return _count(cut_lineage(short.unionByName(far), "align_blocks"), kind, len(_tokenizers(*vocabularies).b_bytes))


def _count(blocks: DataFrame, kind: str, n_b_ids: int) -> DataFrame:
    """Corpus counts of the pairs, back to the blocks' lists and from there to the texts' links."""
    lists = (blocks.where("pairs is not null").select(F.col("block").alias("list"), F.posexplode(F.arrays_zip("pairs", "docs")).alias("pos", "x"))
             .select("list", "pos", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs")))
    counts = cut_lineage(lists.groupBy("pair").agg(F.sum("docs").alias("n"))
                         .withColumn("a", F.floor(F.col("pair") / n_b_ids).cast("int")), "align_counts")
    # one row per id of A at most: bounded by the vocabulary
    best = counts.groupBy("a").agg(F.max("n").alias("top"))
    counts = counts.join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    replies = lists.select("list", "pos", "pair").join(counts, "pair").select("list", "pos", "n", "best")
    texts = blocks.where("pairs is null").drop("pairs", "docs")

    def apply(rows: pa.Table, reply: pa.Table) -> pa.Table:
        pos = reply["pos"].to_numpy()
        n, best = np.zeros(len(pos), np.int64), np.zeros(len(pos), bool)
        n[pos], best[pos] = reply["n"].to_numpy(), reply["best"].to_numpy()
        n_best, count_sum = [], []
        for size, links in zip(rows["size"].to_pylist(), rows["links"].to_pylist()):
            steps, used = _unpack(links, size)
            times, _ = _unpack(links[used:], size)
            place = np.cumsum(steps)
            n_best.append(int(times[best[place]].sum()))
            count_sum.append(int((n[place] * times).sum()))
        keep = rows.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
        return keep.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))
    return texts.groupBy("block").cogroup(replies.groupBy("list")).applyInArrow(
        apply, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
