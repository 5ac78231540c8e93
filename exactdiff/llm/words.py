"""Hashes of the words of whole texts, computed over the bytes of an Arrow string column.

A word is a maximal run of bytes of a class given as a table of 256 flags; letters A-Z count as a-z.
The work goes by numpy over blocks of about a quarter of a million bytes that are cut between words, so a text of any
length takes bounded memory beside its own bytes and one integer for each of its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Words that white space divides: all bytes but 0x20 and 0x09-0x0D.
SPACED = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
#: Words of digits, ASCII letters and whatever is not ASCII.
ALNUM = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])

#: Each byte, A-Z as a-z.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_BLOCK = 1 << 18
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))[LOWER]
_STEP = 0x5851F42D4C957F2D
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        back = pow(_STEP, -1, 1 << 64)
        for name, base in (("up", _STEP), ("back", back)):
            x = np.full(n, base, dtype=np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["back"][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them; null rows are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def hashed(raw: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word in order: its hash, its row, its first byte and the byte after its last."""
    hashes, begins, ends = [], [], []
    lo, n = 0, len(raw)
    edge = np.unique(at[:-1][at[:-1] < n]) if n else at[:0]
    while lo < n:
        hi = min(lo + _BLOCK, n)
        while hi < n and kind[raw[hi]] and kind[raw[hi - 1]]:
            free = np.flatnonzero(~kind[raw[lo:hi]])
            if len(free):
                hi = lo + int(free[-1]) + 1
            else:
                hi = min(hi + _BLOCK, n)
        part = raw[lo:hi]
        inside = kind[part]
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        new = edge[np.searchsorted(edge, lo) : np.searchsorted(edge, hi)] - lo
        before[new] = False
        begin = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        after[new[new > 0] - 1] = False
        end = np.flatnonzero(inside & ~after) + 1
        up, back = _power(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_LETTER[part] * back[: len(part)], out=total[1:])
        h = (total[end] - total[begin]) * up[begin]
        hashes.append(mix(h + (end - begin).astype(np.uint64)))
        begins.append(begin + lo)
        ends.append(end + lo)
        lo = hi
    if not hashes:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    begin = np.concatenate(begins)
    row = np.searchsorted(at, begin, side="right") - 1
    return np.concatenate(hashes), row, begin, np.concatenate(ends)


def word_hash(word: str, kind: np.ndarray = SPACED) -> int:
    """The hash that hashed() gives a word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    h = hashed(raw, np.array([0, len(raw)]), kind)[0]
    if len(h) != 1:
        raise ValueError(f"not one word: {word!r}")
    return int(h[0])


def shingles(hashes: np.ndarray, row: np.ndarray, n_rows: int, width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each row, as hashes of `width` consecutive words; a row of fewer words has
    its whole sequence as its one shingle, and a row without words has none."""
    first = np.searchsorted(row, np.arange(n_rows + 1))
    n = len(hashes) - width + 1
    if n > 0:
        h = np.zeros(n, np.uint64)
        for k in range(width):
            h *= _U(_STEP)
            h += hashes[k : k + n]
        h = mix(h)
    out = []
    for r in range(n_rows):
        a, b = int(first[r]), int(first[r + 1])
        if b - a >= width:
            x = np.sort(h[a : b - width + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif b > a:
            x = 0
            for v in hashes[a:b].tolist():
                x = (x * _STEP + v) % (1 << 64)
            out.append(mix(np.array([x ^ (b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
