"""Byte-level BPE encoding and decoding by transducers.

Encoding. A token sequence is the BPE encoding of its bytes exactly when each
pair of neighbours is the encoding of the pair's own bytes; so every prefix
of a piece of text has one last token, and the encodings of all prefixes form
a nondeterministic transducer: a hypothesis is an encoded prefix, known by
its last token, plus a partial token (a prefix of vocabulary entries).
Reading a byte extends the partial tokens and, where one completes a token
that may stand after its hypothesis' last one, opens a hypothesis with an
empty partial token. ``Encoder`` determinises this while it reads: a state is
the set of live hypotheses, and transitions are kept by (state, byte), each
with the token that ends at that byte. The live partial tokens are suffixes of
the longest one, so a state is that one's number and the last tokens of all,
longest partial token first. A token is emitted once all live hypotheses agree
on it, after a lookahead of a few vocabulary entries.

Decoding. ``Decoder`` runs the incremental UTF-8 machine over runs of tokens:
its state is the incomplete sequence at the end of what was read (at most
three bytes), its output the text completed so far. Bytes that are not UTF-8
become U+FFFD.

Both are exact for texts of any length, need memory bounded by ``KEEP``
(or twice as many) entries each (the tables start afresh beyond it, that of
pieces keeps the younger half; results stay the same), run per document and
shuffle nothing.

Defined cases: null text counts as empty (no ids); empty tables give empty
results; repeated rows are each encoded; columns of the input beside the id
and text are not read by ``encode``.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: entries kept in each lazily filled table of a Python worker
KEEP = 150_000
#: rows handled at a time, so that a worker holds little beside its tables
ROWS = 500
#: longer pieces are not kept whole but always run through the transducer
LONG_PIECE = 48
#: characters from which the pieces of a text are not listed at once
LONG_TEXT = 1 << 18
#: bytes between two looks for tokens that can be emitted; tokens decoded at a time
FLUSH, RUN = 4096, 8192


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The rank file: a base64 token and its rank on every line."""
    return {base64.b64decode(tok): int(rank) for tok, rank in (line.split() for line in data.splitlines() if line)}


def merge_by_rank(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Plain BPE of a short byte string: join the neighbours of lowest rank,
    leftmost first. Defines which pairs of tokens may stand side by side."""
    parts = [data[i:i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best == 1 << 60:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Pieces(dict):
    """Piece of text -> its ids as bytes, filled on demand. Two generations of
    ``KEEP`` pieces: those in use move from the older one to the younger."""

    def __init__(self, piece):
        super().__init__()
        self.piece = piece
        self.older: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        ids = self.older.get(text)
        if ids is None:
            ids = pack(self.piece(text.encode("utf-8")))
        if len(text) <= LONG_PIECE:
            if len(self) >= KEEP:
                self.older = dict(self)
                self.clear()
            self[text] = ids
        return ids


class Encoder:
    """Lazily determinised transducer from bytes to tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        self.ranks = ranks
        self.split = regex.compile(pattern)
        self.token = {r: t for t, r in ranks.items()}
        self.parts = sorted({t[:k] for t in ranks for k in range(len(t) + 1)})
        self.part_no = {p: n for n, p in enumerate(self.parts)}
        self.bytes = [bytes((b,)) for b in range(256)]
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.steps: dict[int, tuple] = {}
        self.stays: dict[tuple, tuple] = {}     # few differ: steps share them
        self.pieces = Pieces(self.piece)
        self._reset()

    def _reset(self) -> None:
        # a state: the number of the longest partial token, then the last tokens; the empty part is number 0
        self.numbers: dict[tuple, int] = {(0, None): 0}
        self.states = list(self.numbers)
        self.moves: dict[int, int] = {}

    def _lengths(self, part: int) -> list[int]:
        """Lengths of the suffixes of a partial token that are partial tokens, longest first."""
        text = self.parts[part]
        return [len(text) - k for k in range(len(text) + 1) if text[k:] in self.part_no]

    def _step(self, part: int, byte: int) -> tuple:
        """What a byte does to the partial tokens, whatever the last tokens are:
        the longest one then, the places of the last tokens that stay, and
        (place, token) of the tokens that may end here, longest first."""
        if len(self.steps) >= KEEP // 2:
            self.steps.clear()
        text, b = self.parts[part], self.bytes[byte]
        longer = [(k, text[len(text) - n:] + b) for k, n in enumerate(self._lengths(part), 1)]
        longer = [(k, p) for k, p in longer if p in self.part_no]
        ends = tuple((k, self.ranks[p]) for k, p in longer if p in self.ranks)
        stay = tuple(k for k, _ in longer)
        found = self.steps[part << 8 | byte] = self.part_no[longer[0][1]], self.stays.setdefault(stay, stay), ends
        return found

    def _split(self, tok: int) -> tuple[int, int] | None:
        """The two tokens whose merge made ``tok``; None for a single byte."""
        if tok not in self.halves:
            data = self.token[tok]
            earlier = {t: r for t, r in self._inside(data) if r < tok or len(t) == 1}
            self.halves[tok] = tuple(merge_by_rank(data, earlier)) if len(data) > 1 else None
        return self.halves[tok]

    def _inside(self, data: bytes) -> Iterator[tuple[bytes, int]]:
        for i in range(len(data)):
            for j in range(i + 1, len(data) + 1):
                r = self.ranks.get(data[i:j])
                if r is not None:
                    yield data[i:j], r

    def _survives(self, left: int, right: int) -> bool:
        """Whether no merge over the border of two tokens comes before the
        merges that make them: undo the later merge of the two sides and
        compare with the border's merge at that time; of equal merges the
        left one goes first."""
        limit = 1 << 60
        while True:
            over = self.ranks.get(self.token[left] + self.token[right])
            if over is not None and over < limit:
                return False
            a, b = self._split(left), self._split(right)
            if a is not None and (b is None or left > right):
                limit, left = left, a[1]
            elif b is not None:
                limit, right = right + 1, b[0]
            else:
                return True

    def _fits(self, left: int, right: int) -> bool:
        key = left << 32 | right
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= 2 * KEEP:
                self.pairs.clear()
            ok = self.pairs[key] = self._survives(left, right)
        return ok

    def _move(self, number: int, byte: int) -> int:
        """Next state, shifted by 40 bits, and the token that ends at this byte."""
        state = self.states[number]
        part, stay, ends = self.steps.get(state[0] << 8 | byte) or self._step(state[0], byte)
        for k, ended in ends:
            last = state[k]
            if last is None or self._fits(last, ended):
                break
        held = (part, *[state[k] for k in stay], ended)
        to = self.numbers.setdefault(held, len(self.states))
        if to == len(self.states):
            self.states.append(held)
        move = self.moves[number << 8 | byte] = to << 40 | ended
        return move

    def _path(self, ends: list[int], at: int) -> list[int]:
        """Tokens of the prefix of ``at`` bytes, last first."""
        out = []
        while at:
            out.append(ends[at - 1])
            at -= len(self.token[out[-1]])
        return out

    def piece(self, data: bytes) -> list[int]:
        """The tokens of one piece."""
        if len(self.moves) >= KEEP:
            self._reset()
        out: list[int] = []
        state, ends, moves = 0, [], self.moves      # the state's number, shifted by 8 bits
        for byte in data:
            move = moves.get(state | byte) or self._move(state >> 8, byte)
            state = move >> 32
            ends.append(move & 0xFFFFFFFF)
            if len(ends) >= FLUSH:
                lengths = self._lengths(self.states[state >> 8][0])
                paths = [self._path(ends, len(ends) - n)[::-1] for n in lengths]
                agreed = 0
                while all(len(p) > agreed for p in paths) and len({p[agreed] for p in paths}) == 1:
                    agreed += 1
                out += paths[0][:agreed]
                del ends[:sum(len(self.token[t]) for t in paths[0][:agreed])]
        return out + self._path(ends, len(ends))[::-1]

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if len(text) <= LONG_TEXT:
            return b"".join(map(self.pieces.__getitem__, self.split.findall(text)))
        out = bytearray()
        for match in self.split.finditer(text):     # one piece at a time
            out += self.pieces[match.group()]
        return bytes(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()


def utf8_step(held: bytes, data: bytes) -> tuple[str, bytes]:
    """Text completed by ``held + data`` and the incomplete rest (at most 3 bytes)."""
    data = held + data
    keep = 0
    for back in range(1, min(3, len(data)) + 1):
        lead = data[-back]
        if lead >= 0xC0:
            need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            keep = back if back < need else 0
            break
        if lead < 0x80:
            break
    body, rest = (data[:-keep], data[-keep:]) if keep else (data, b"")
    return body.decode("utf-8", "replace"), rest


class Decoder:
    """Streaming decoder: feed tokens, get the text completed so far."""

    def __init__(self, ranks: dict[bytes, int]):
        self.token = {r: t for t, r in ranks.items()}

    def feed(self, held: bytes, ids: Iterable[int]) -> tuple[str, bytes]:
        return utf8_step(held, b"".join(map(self.token.__getitem__, ids)))

    def decode(self, ids: Sequence[int]) -> str:
        out, held = [], b""
        for at in range(0, len(ids), RUN):
            run = ids[at:at + RUN]
            text, held = self.feed(held, run.tolist() if isinstance(run, np.ndarray) else run)
            out.append(text)
        return "".join(out) + held.decode("utf-8", "replace")

    def decode_bytes(self, ids: pa.BinaryScalar) -> str:
        """The text of ids as ``encode_bytes`` writes them; null has none."""
        return self.decode(np.frombuffer(ids.as_buffer(), "<u4") if ids.is_valid else ())


@lru_cache(maxsize=2)
def _ranks(data: bytes) -> dict[bytes, int]:
    return read_ranks(data)


@lru_cache(maxsize=2)
def _encoder(data: bytes, pattern: str) -> Encoder:
    return Encoder(_ranks(data), pattern)


@lru_cache(maxsize=2)
def _decoder(data: bytes) -> Decoder:
    return Decoder(_ranks(data))


def _rank_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``ids``: the tokens as little-endian unsigned
    32-bit integers. The rank file (below 1 MB) is read by the driver and
    sent along, so executors need no copy of it."""
    return _encoded(df, ranks_path, pattern, text_col, keep, None)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text",
               keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``encode`` and then ``decode`` of its ids (column ``decoded``), in the
    same Python worker: half as many workers are alive at a time."""
    return _encoded(df, ranks_path, pattern, text_col, keep, "decoded")


def _encoded(df: DataFrame, ranks_path: str, pattern: str, text_col: str, keep: tuple[str, ...], out_col: str | None) -> DataFrame:
    files = df.sparkSession.sparkContext.broadcast(_rank_file(ranks_path))
    names = [*keep, "ids", *([out_col] if out_col else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = _encoder(files.value, pattern), _decoder(files.value)
        for batch in _slices(batches):
            ids = pa.array([enc.encode_bytes(t or "") for t in _strings(batch.column(batch.num_columns - 1))], pa.binary())
            back = [pa.array([dec.decode_bytes(x) for x in ids], pa.string())] if out_col else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids, *back], names=names)

    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("ids"))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]] + ["ids binary"]
    return src.mapInArrow(run, ", ".join(schema + ([f"`{out_col}` string"] if out_col else [])))


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The input's columns and the text of its ids (UTF-8)."""
    files = df.sparkSession.sparkContext.broadcast(_rank_file(ranks_path))
    if out_col in df.columns:
        raise ValueError(f"the input already has a column {out_col}")
    at = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = _decoder(files.value)
        for batch in _slices(batches):
            texts = [dec.decode_bytes(x) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             names=[*batch.schema.names, out_col])

    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{out_col}` string"])
    return df.mapInArrow(run, out)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _strings(column: pa.Array) -> Iterator[str | None]:
    return (x.as_py() for x in column)
