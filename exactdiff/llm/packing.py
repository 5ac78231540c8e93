"""Packing documents into sequences, and the two orders in which this package does it.

`hilbert_pack`: space-filling-curve order. A document's words are hashed into FEATURES counts, damped by a logarithm and
scaled to length one; a fixed random matrix projects the vector to DIMS coordinates, each cut into 2**BITS cells, and
the cells' place along a Hilbert curve is the document's key. Documents are dealt to ranges of the curve that hold about
PARTITION_BYTES of text each (or more, so that there are PARTITIONS at most), by a histogram of the bytes over 2**CELL_BITS
stretches of the curve. A stretch with more text than a partition is cut again by the next bits of the key, until it
holds less or a single key, which is dealt to several partitions by a hash of doc_id, so that a key which any number of
documents share spreads. Each partition sorts by (key, doc_id, text) and lays its documents end to end into sequences of
`length` tokens, cutting wherever a sequence is full. Only a partition's last sequence is not full.

`best_fit_pack`: best-fit-decreasing. Documents longer than a sequence are split losslessly into full pieces and a
rest. Each task takes pieces in windows of WINDOW tokens; from the longest on, a piece goes to the sequence with the
least sufficient room, found by a segment tree over the rooms 0..length (each leaf holds how many open sequences have
that room). No rows move between tasks, and a task holds a window at most.

Both are repeatable: a task that runs again gets the same rows in the same order and numbers its sequences alike.

Defined cases: null text is empty and has the end token only; a text of any length is whole; repeated rows are packed
as documents of their own; an empty table gives an empty result; other columns are not looked at. A null doc_id sorts
first and stays null.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exactdiff.llm.common import cut, release
from exactdiff.llm.tokens import Encoder, default_path
from exactdiff.llm.words import SPACED, buffers, hashed, mix

FEATURES, DIMS, BITS = 1024, 6, 8
END = 2
LENGTH = 4096
#: Bytes of text in a partition of the sort, about, beside one document; partitions grow in number first, up to PARTITIONS.
PARTITION_BYTES, PARTITIONS = 24_000_000, 1 << 16
CELL_BITS = 16
#: Bits by which a heavy stretch is cut at least.
MORE = 6
#: Tokens that a task packs together by best fit.
WINDOW = 1 << 21
_ROWS, _BYTES = 200, 1 << 21


def _slices(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[pa.RecordBatch]:
    """Parts of batches of _ROWS rows at most and about _BYTES bytes of text, or one row."""
    for b in batches:
        at = buffers(b.column(text))[1]
        lo = 0
        while lo < len(b):
            hi = min(lo + _ROWS, max(lo + 1, int(np.searchsorted(at, at[lo] + _BYTES))), len(b))
            yield b.slice(lo, hi - lo)
            lo = hi
        release()


def _directions() -> np.ndarray:
    return np.random.default_rng(20240607).standard_normal((FEATURES, DIMS)).astype(np.float32)


def vectors(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The projected vectors of texts, each coordinate within about -3..3; zeros for texts without words."""
    h, row, _, _ = hashed(raw, at, SPACED)
    n = len(at) - 1
    counts = np.bincount(row * FEATURES + (h >> np.uint64(54)).astype(np.int64), minlength=n * FEATURES).reshape(n, FEATURES)
    x = _LOGS[counts] if counts.max(initial=0) < len(_LOGS) else np.log1p(counts).astype(np.float32)
    size = np.sqrt((x * x).sum(1, keepdims=True))
    # one row at a time, so that a text's key never depends on its neighbours
    return np.stack([(v @ _DIRECTIONS) for v in x / np.maximum(size, 1e-9)]) if n else np.zeros((0, DIMS), np.float32)


_DIRECTIONS = _directions()
#: The damped counts of words that are not very many.
_LOGS = np.log1p(np.arange(1 << 12)).astype(np.float32)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place of integer cells (rows of coordinates below 2**bits) along a Hilbert curve: the published
    transposition algorithm, Gray code undone from the top bit down."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _keys(b: pa.RecordBatch) -> np.ndarray:
    cells = np.clip((vectors(*buffers(b.column(1))) + 3) / 6 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert_key(cells)


_CELL = np.int64(DIMS * BITS - CELL_BITS)


def _rows_of(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


class Stretches:
    """The curve cut into stretches: begin has each one's first key, in order, and bits how many bits of the key run free
    in it."""

    def __init__(self, begin: np.ndarray, bits: np.ndarray) -> None:
        self.begin, self.bits = begin, bits

    def of(self, key: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, key, side="right") - 1

    def cut(self, more: np.ndarray, kept: np.ndarray) -> Stretches:
        """Those kept, each cut by some more bits."""
        begin, bits, more = self.begin[kept], self.bits[kept] - more[kept], more[kept]
        count = np.int64(1) << more
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return Stretches(np.repeat(begin, count) + (step << np.repeat(bits, count)), np.repeat(bits, count))


def curve_keys(docs: DataFrame, text: str = "text") -> DataFrame:
    """key, n: each document's place on the curve, and the bytes of its text and one more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(_keys(b)), pa.array(np.diff(buffers(b.column(1))[1]) + 1)], names=["key", "n"])

    return _rows_of(docs, text).mapInArrow(run, "key long, n long")


def curve_bytes(keys: DataFrame, stretches: Stretches) -> np.ndarray:
    """The bytes in each of the curve's stretches."""
    shared = keys.sparkSession.sparkContext.broadcast(stretches)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value.begin), np.int64)
        for b in batches:
            np.add.at(total, shared.value.of(b.column(0).to_numpy()), b.column(1).to_numpy())
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["stretch", "n"])

    out = np.zeros(len(stretches.begin), np.int64)
    # no more rows than there are stretches, whose number is bounded
    for stretch, n in keys.mapInArrow(run, "stretch long, n long").groupBy("stretch").agg(F.sum("n")).collect():
        out[stretch] = n
    return out


def curve_stretches(docs: DataFrame, text: str = "text") -> tuple[Stretches, np.ndarray, int]:
    """Stretches, the bytes of each, and the bytes of a partition. A stretch that holds more than a partition is cut again
    by some more bits, until it holds less or a single key; keys are computed once for that, and empty stretches go."""
    keys = cut(curve_keys(docs, text))
    stretches = Stretches(np.arange(1 << CELL_BITS) << _CELL, np.full(1 << CELL_BITS, _CELL))
    while True:
        size = curve_bytes(keys, stretches)
        each = max(PARTITION_BYTES, -(-int(size.sum()) // PARTITIONS))
        heavy = (size > each) & (stretches.bits > 0)
        if not heavy.any():
            return stretches, size, each
        more = np.ceil(np.log2(np.maximum(8 * size / each, 1))).astype(np.int64)
        stretches = stretches.cut(np.where(heavy, np.minimum(np.maximum(more, MORE), stretches.bits), 0), size > 0)


def curve_order(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text and curve_key, dealt along the curve and sorted. Only a stretch that still holds more than a partition
    is dealt by a hash of doc_id and size: its documents have one key."""
    stretches, size, each = curve_stretches(docs, text)
    ends = np.cumsum(size)
    parts = max(1, -(-int(ends[-1]) // each))
    first = (ends - size) // each
    span = np.maximum(1, -(-ends // each) - first) * (size > each) + (size <= each)
    shared = docs.sparkSession.sparkContext.broadcast((stretches, first, span))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretches, first, span = shared.value
        for b in _slices(batches):
            key = _keys(b)
            at = stretches.of(key)
            ids = b.column(0).fill_null(-1).to_numpy().astype(np.uint64) ^ (np.diff(buffers(b.column(1))[1]).astype(np.uint64) << np.uint64(40))
            part = first[at] + (mix(ids) % span[at].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(key), pa.array(part.astype(np.int32))], names=["doc_id", "text", "curve_key", "part"])

    dealt = _rows_of(docs, text).mapInArrow(run, "doc_id long, text string, curve_key long, part int")
    return dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("curve_key", "doc_id", "text").drop("part")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class _Rows:
    """Rows of PIECES, without ids unless they are wanted."""

    def __init__(self, ids: bool) -> None:
        self.names = [x.split()[0] for x in PIECES.split(", ")][: 8 if ids else 7]
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, doc_id, start, ids: np.ndarray, total, sequence, offset) -> None:
        raw = ids.astype("<u4").tobytes()
        self.rows.append((doc_id, start, len(ids), zlib.crc32(raw), total, sequence, offset, raw))
        self.bytes += len(raw)

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if k == "ids" else pa.int64()) for k, x in zip(self.names, zip(*self.rows))], names=self.names)
        self.rows, self.bytes = [], 0
        return out


def hilbert_pack(docs: DataFrame, tokenizer: str | None = None, end: int = END, length: int = LENGTH, text: str = "text", ids: bool = True) -> DataFrame:
    """A row for each piece, as PIECES: which tokens of its document it holds, and where it lies in which sequence;
    the ids themselves are left out if ids is false."""
    path = tokenizer or default_path()
    ordered = curve_order(docs, text).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, end)
        sequence, used, out = TaskContext.get().partitionId() << 40, 0, _Rows(ids)
        for b in _slices(batches):
            for doc_id, tokens in zip(b.column(0).to_pylist(), encoder.encode_column(b.column(1))):
                start = 0
                while start < len(tokens):
                    n = min(length - used, len(tokens) - start)
                    out.add(doc_id, start, tokens[start : start + n], len(tokens), sequence, used)
                    start, used = start + n, used + n
                    if used == length:
                        sequence, used = sequence + 1, 0
                    if out.bytes > 1 << 22:
                        yield out.batch()
        if out.rows:
            yield out.batch()

    return ordered.mapInArrow(run, PIECES if ids else PIECES.removesuffix(", ids binary"))


class Rooms:
    """A segment tree over rooms 0..length: take(n) gives the least room of at least n that some open sequence has."""

    def __init__(self, length: int) -> None:
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        i = room + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, n: int) -> tuple[int, int] | None:
        """The sequence and its room; it is no longer open."""
        i = n + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.leaves
        while i:
            self.count[i] -= 1
            i >>= 1
        return self.open[room].pop(), room


def best_fit(sizes: list[int], length: int) -> list[tuple[int, int]]:
    """Of each piece, its sequence and offset; sequences are numbered from 0. Longest pieces first, ties in order."""
    rooms, n, out = Rooms(length), 0, [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        if found := rooms.take(sizes[i]):
            sequence, room = found
        else:
            sequence, room, n = n, length, n + 1
        out[i] = sequence, length - room
        if room > sizes[i]:
            rooms.put(room - sizes[i], sequence)
    return out


SEQUENCES = "sequence_id long, n_tokens long, n_segments long, ids binary, cumulative_lengths array<int>, position_resets array<int>, doc_ids array<long>, starts array<long>"


def best_fit_pack(docs: DataFrame, tokenizer: str | None = None, end: int = END, length: int = LENGTH, pad: int = 0, text: str = "text") -> DataFrame:
    """A row for each sequence: ids (length little-endian 32-bit ids, padded), the cumulative lengths of its segments
    (0 first, padding left out), the offsets at which positions start again from 0, and the document and the place in
    it that each segment begins with."""
    path = tokenizer or default_path()

    def pack(pieces: list[tuple], first: int) -> tuple[pa.RecordBatch, int]:
        placed = best_fit([len(x[2]) for x in pieces], length)
        n = 1 + max(s for s, _ in placed)
        matrix = np.full((n, length), pad, "<u4")
        inside: list[list[tuple]] = [[] for _ in range(n)]
        for (doc_id, start, ids), (s, offset) in zip(pieces, placed):
            matrix[s, offset : offset + len(ids)] = ids
            inside[s].append((offset, doc_id, start, len(ids)))
        columns: list[list] = [[] for _ in range(8)]
        for s, parts in enumerate(inside):
            parts.sort(key=lambda x: x[0])
            ends = [0, *np.cumsum([x[3] for x in parts]).tolist()]
            for c, x in zip(columns, (first + s, ends[-1], len(parts), matrix[s].tobytes(), ends, [x[0] for x in parts], [x[1] for x in parts], [x[2] for x in parts])):
                c.append(x)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in SEQUENCES.split(", ")]), first + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, end)
        sequence, pieces, tokens = TaskContext.get().partitionId() << 40, [], 0
        for b in _slices(batches):
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder.encode_column(b.column(1))):
                for start in range(0, len(ids), length):
                    pieces.append((doc_id, start, ids[start : start + length]))
                    tokens += len(pieces[-1][2])
                    if tokens >= WINDOW:
                        out, sequence = pack(pieces, sequence)
                        pieces, tokens = [], 0
                        yield out
        if pieces:
            yield pack(pieces, sequence)[0]

    return _rows_of(docs, text).mapInArrow(run, SEQUENCES)


def write_packed(packed: DataFrame, folder: str) -> None:
    """best_fit_pack()'s rows as binary part files below a folder that all executors share: ids_*.bin (matrix rows of
    little-endian 32-bit ids), positions_*.bin (each token's position, 0 at every reset and in padding),
    lengths_*.bin (for each row the number of cumulative lengths and then these). A part's file is written under a
    name of its task's attempt and then renamed, so a task that runs twice leaves one whole file."""
    os.makedirs(folder, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        names = {k: os.path.join(folder, f"{k}_{part:06d}.bin") for k in ("ids", "positions", "lengths")}
        files = {k: open(f"{x}.{attempt}", "wb") for k, x in names.items()}
        rows = 0
        for b in batches:
            for raw, ends in zip(b.column("ids"), b.column("cumulative_lengths")):
                raw, ends = raw.as_py(), np.array(ends.as_py(), "<u4")
                positions = np.zeros(len(raw) // 4, "<u4")
                for i, j in zip(ends[:-1], ends[1:]):
                    positions[i:j] = np.arange(j - i)
                files["ids"].write(raw)
                files["positions"].write(positions.tobytes())
                files["lengths"].write(np.array([len(ends)], "<u4").tobytes() + ends.tobytes())
                rows += 1
        for k, f in files.items():
            f.close()
            os.replace(f.name, names[k])
        yield pa.RecordBatch.from_pydict({"rows": pa.array([rows], pa.int64())})

    packed.select("ids", "cumulative_lengths").mapInArrow(write, "rows long").agg(F.sum("rows")).collect()
