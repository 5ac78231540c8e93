"""Byte-level BPE by corpus-level merge replay, and decoding.

Texts are split by a pattern, and each match (a word here) is encoded by itself: a word that is a token is that token;
else its bytes are merged, always the leftmost of the pairs of neighbours that make the token of least rank.

A task replays the merges over all words of many texts together. An inverted index leads from what a pair of
neighbouring tokens makes to the places of such pairs in all words; merges are taken in the order of their rank, each at
all its places from left to right, and only the neighbours of a merged pair enter the index anew. A new pair may rank
lower than the merge at hand (the parts of a token can be younger than the token): the rest of that word then waits
until the lower one has been replayed, so each word sees its merges in the order that its own greedy merging has.

Each distinct word of a task's texts is replayed once and remembered, up to REMEMBERED words and REMEMBERED_CHARS
characters, and texts are never shuffled: a word's ids depend on nothing else, and to bring each distinct word of the
corpus to one place and its ids back would move more bytes than the texts have. Texts are taken whole; of a long one the
matches are looked up LOOKED_UP at a time, so memory is in proportion to the longest text.

Defined cases: a null text is the empty text, which has no ids; rows are kept as they are, with their doc_id, repeated
or null; ids that the vocabulary lacks make decoding fail; null ids decode to null; an empty table gives an empty one;
extra columns are ignored by `encode` and kept by `decode`.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator, Sequence
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exactdiff.llm.common import free_name, release
from exactdiff.llm.tokens import _gather, _Pool

REMEMBERED, REMEMBERED_CHARS = 300_000, 12_000_000
LOOKED_UP = 1 << 18
#: Characters of texts that are encoded together.
TOGETHER = 8_000_000
#: Characters of words over which merges are replayed together, or one longer word.
REPLAYED = 1 << 22
#: Places of a merge in one word from which on they are merged one by one instead of in rounds.
MANY = 8


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


class Merges:
    """The merges that a table of ranks stands for; every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.base = max(self.token) + 1
        #: What two neighbouring tokens make: every cut of a token into two tokens.
        self.made = {ranks[t[:i]] * self.base + ranks[t[i:]]: rank for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.pairs = np.array(sorted(self.made), np.int64)
        self.makes = np.array([self.made[x] for x in self.pairs.tolist()], np.int64)

    def make(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The tokens that neighbours make, or -1."""
        if not len(self.pairs):
            return np.full(len(left), -1, np.int64)
        pair = left * self.base + right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.makes[at], -1)

    def replay(self, words: Sequence[bytes]) -> list[list[int]]:
        """The ids of each word."""
        out: list[list[int]] = [[self.ranks[w]] if w in self.ranks else [] for w in words]
        open_words = [i for i, w in enumerate(words) if w and not out[i]]
        if open_words:
            for i, ids in zip(open_words, _Replay(self, [words[i] for i in open_words]).run()):
                out[i] = ids
        return out


class _Replay:
    """The tokens of some words as linked lists in arrays, and the inverted index of their pairs. Of a merged pair the
    left place keeps the new token and the right one drops out."""

    def __init__(self, merges: Merges, words: Sequence[bytes]) -> None:
        self.merges = merges
        size = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(size)
        self.first, n = ends - size, int(ends[-1])
        self.token = merges.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        self.word = np.repeat(np.arange(len(words)), size)
        self.left, self.right = np.arange(-1, n - 1), np.arange(1, n + 1)
        self.left[self.first], self.right[ends - 1] = -1, -1
        #: What the pair that begins at a place makes now, or -1.
        self.made = np.full(n, -1, np.int64)
        self.places: dict[int, list[np.ndarray]] = {}
        self.ranks: list[int] = []
        p = np.flatnonzero(self.right >= 0)
        self.enter(p, merges.make(self.token[p], self.token[self.right[p]]))

    def enter(self, p: np.ndarray, made: np.ndarray) -> None:
        """Notes what the pairs that begin at some places make, and puts them into the index."""
        self.made[p] = made
        p, made = p[made >= 0], made[made >= 0]
        order = np.argsort(made, kind="stable")
        p, made = p[order], made[order]
        starts = np.flatnonzero(np.diff(made, prepend=-1))
        for rank, some in zip(made[starts].tolist(), np.split(p, starts[1:])):
            if rank not in self.places:
                self.places[rank] = []
                heapq.heappush(self.ranks, rank)
            self.places[rank].append(some)

    def run(self) -> list[list[int]]:
        while self.ranks:
            rank = heapq.heappop(self.ranks)
            p = np.concatenate(self.places.pop(rank))
            p = np.sort(p[self.made[p] == rank])  # of the others one token has been merged with another since
            p = p[np.diff(p, prepend=-1) > 0]
            if not len(p):
                continue
            starts = np.flatnonzero(np.diff(self.word[p], prepend=-1))
            if len(starts) == len(p):
                self.merge_apart(rank, p)
                continue
            # a word's first place is merged now, its others in the next round or, if they are many, one by one
            count = np.diff(starts, append=len(p))
            many = np.repeat(count > MANY, count)
            first = np.zeros(len(p), bool)
            first[starts] = True
            rest = p[~first & ~many]
            self.enter(rest, np.full(len(rest), rank))
            self.merge_apart(rank, p[first & ~many])
            self.merge_in_turn(rank, p[many].tolist())
        kept = self.token >= 0
        ids = self.token[kept].tolist()
        ends = np.cumsum(kept)[np.append(self.first[1:], len(kept)) - 1].tolist()
        return [ids[lo:hi] for lo, hi in zip([0, *ends], ends)]

    def merge_apart(self, rank: int, p: np.ndarray) -> None:
        """Merges places of which no two are in one word."""
        q = self.right[p]
        after, before = self.right[q], self.left[p]
        self.token[p], self.token[q], self.made[q], self.made[p], self.right[p] = rank, -1, -1, -1, after
        behind, front = after >= 0, before >= 0
        self.left[after[behind]] = p[behind]
        fixed = np.full(len(p), rank)
        left = self.merges.make(self.token[before[front]], fixed[front])
        self.enter(np.concatenate((before[front], p[behind])), np.concatenate((left, self.merges.make(fixed[behind], self.token[after[behind]]))))

    def merge_in_turn(self, rank: int, places: list[int]) -> None:
        """Merges places from left to right. Where a new pair makes a token of lower rank, the rest of its word waits."""
        token, left, right, made, pairs, base = self.token, self.left, self.right, self.made, self.merges.made, self.merges.base
        new, later, waits = [], [], -1
        for p in places:
            if made[p] != rank:
                continue
            if self.word[p] == waits:
                later.append(p)
                continue
            q = right[p]
            after, before = right[q], left[p]
            token[p], token[q], made[q], made[p], right[p] = rank, -1, -1, -1, after
            if before >= 0:
                made[before] = pairs.get(int(token[before]) * base + rank, -1)
                new.append(before)
            if after >= 0:
                left[after] = p
                made[p] = pairs.get(rank * base + int(token[after]), -1)
                new.append(p)
            if any(0 <= made[x] < rank for x in (before, p) if x >= 0):
                waits = self.word[p]
        if new or later:
            some = np.unique(np.array(new + later, np.int64))
            self.enter(some, made[some])


class _Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    """Ids of whole texts; keeps what it knows of words between calls."""

    def __init__(self, merges: Merges, pattern: str) -> None:
        import regex

        self.merges, self.pattern = merges, regex.compile(pattern)
        self.forget()

    def forget(self) -> None:
        self.numbers, self.chars = _Numbers(), 0
        self.ids, self.begin, self.size = _Pool(np.uint32), _Pool(np.int64), _Pool(np.int64)

    def learn(self) -> None:
        """Replays the words that are numbered and not yet encoded."""
        new = list(islice(self.numbers, self.size.used, None))
        ends = np.cumsum([len(w) for w in new], dtype=np.int64)
        lo = 0
        while lo < len(new):
            before = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + REPLAYED, side="right")))
            found = self.merges.replay([w.encode() for w in new[lo:hi]])
            size = np.array([len(x) for x in found], np.int64)
            first = self.ids.add(np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())))
            self.begin.add(first + np.cumsum(size) - size)
            self.size.add(size)
            self.chars += int(ends[hi - 1]) - before
            lo = hi

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of each text, as 32-bit integers."""
        if len(self.numbers) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.forget()
        number, looked_up = self.numbers.__getitem__, []
        for text in texts:
            matches = (m[0] for m in self.pattern.finditer(text)) if len(text) > LOOKED_UP else iter(self.pattern.findall(text))
            parts = []
            while part := list(islice(matches, LOOKED_UP)):
                parts.append(np.fromiter(map(number, part), np.int64, len(part)))
            looked_up.append(np.concatenate(parts) if parts else np.zeros(0, np.int64))
        self.learn()
        return [self.ids.items[_gather(self.begin.items[x], self.size.items[x])] for x in looked_up]


_merges: dict[str, Merges] = {}
_encoders: dict[tuple[str, str], Encoder] = {}


def merges_of(path: str) -> Merges:
    """The merges of a file, read once by each worker."""
    if path not in _merges:
        _merges[path] = Merges(read_ranks(path))
    return _merges[path]


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit ids) of each row."""
    at = path or default_path(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if at not in _encoders:
            _encoders[at] = Encoder(merges_of(at[0]), at[1])
        encoder = _encoders[at]
        for batch in batches:
            start, size = 0, np.cumsum(batch.column(2).to_numpy(zero_copy_only=False))
            while start < len(size):
                before = size[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(size, before + TOGETHER, side="right")))
                part = batch.slice(start, end - start)
                ids = [x.astype("<u4").tobytes() for x in encoder.encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])
                start = end
        release()

    plain = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), plain.alias("text"), F.length(plain).cast("long").alias("n")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """The rows with decoded: the bytes that their ids stand for, read from the vocabulary alone."""
    at = path or default_path()
    name = free_name(encoded.columns, "decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    place = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = merges_of(at).token
        size = np.full(max(token) + 2, -1, np.int64)
        size[list(token)] = [len(x) for x in token.values()]
        begin = np.zeros(len(size), np.int64)
        begin[list(token)] = np.cumsum(size[list(token)]) - size[list(token)]
        raw = np.frombuffer(b"".join(token.values()), np.uint8)

        def text(x: bytes | None) -> bytes | None:
            if x is None:
                return None
            known = np.minimum(np.frombuffer(x, "<u4"), len(size) - 1)
            if (size[known] < 0).any():
                raise ValueError("an id is not in the vocabulary")
            return raw[_gather(begin[known], size[known])].tobytes()

        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([text(x.as_py()) for x in part.column(place)], pa.binary())], names=[*part.schema.names, name])

    return encoded.mapInArrow(run, f"{schema}, `{name}` binary")
