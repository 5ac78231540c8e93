"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds its distinct word shingles as 64-bit hashes. Two sets link when
`100 * intersection >= percent * union`. The join runs in five steps:

1. Counts. Every set of the corpus adds to a table of `2**SKETCH_BITS` counters (a fixed size), which orders tokens
   from rare to frequent, alike for all documents. Any such order gives the same links; a good one gives few candidates.
2. Prefixes. With `t` the least overlap that a set of n tokens can link with, its prefix has `n - t + l` tokens and a
   partner must share at least `min(l, partner's l)` of them. `l` is chosen for each document: a longer prefix costs
   more list entries and saves verifications; `_lengthen` takes the cheapest by the counts. Sets that are equal are
   one node from here on.
3. Lists. Prefix entries are dealt by token and sorted, and a stream over them drops those that no other node shares.
   A node that keeps fewer entries than its l has no partner of the same or a larger l, so it goes unless a node of a
   smaller l shares a token with it. The rest are listed again. A short list gives pairs that pass the length filter;
   a pair stays if it shares the tokens it needs and its last shared position leaves room for the overlap it needs.
   A list of more than SHORT entries gives no pairs and is never dealt to one task: its entries are tied to the list's
   hub, its node with most entries, and two nodes that are tied to one hub may link.
4. Verification. Parity bits come first: bit i holds the parity of how many of a set's tokens fall on it, so two sets
   differ in at least as many tokens as bits, and pairs that must differ in too many go, exactly. A set has about as
   many bits as tokens, so few pairs that do not link pass. Those that do are verified on whole sets, where a set is
   shipped once for each pair and the set that most of some pairs have in common once for them all: first each node
   with the nearest smaller node that it is paired with, and then the pairs whose nodes are not yet in one component.
   A hub gets some PIVOTS pivots. Each of its nodes is paired with the pivot whose bits are nearest, so that a group of
   near copies of any size takes rows in proportion to its nodes. What that leaves apart is compared in full: the nodes
   outside the hub's largest component with all nodes of the hub, in blocks of BLOCK by BLOCK, ordered by set size so
   that blocks of sets too different in size never meet, by their bits. First each node is verified with the nearest of
   another component; where bits, now FINE times as many, leave pairs open after that, whole blocks are compared through
   a matrix product over the tokens that at least two of their sets have, and each block returns a spanning forest of its
   links. That is quadratic only in the nodes that stay apart from their hub's largest component, as where many texts that do not link are made of the
   same frequent passages.
5. Components of the links, and back from nodes to documents.

Defined cases: null or wordless text has the empty set and links with nothing, other empty sets included; fewer words
than the width make one shingle of the whole sequence; equal sets link; repeated rows count as documents of their own;
an empty table gives an empty result. Other columns of the input are not looked at, whatever their names.
Shingles are told apart by 64-bit hashes, and nodes by 63-bit hashes of their sets, which are not compared: among 10**9
different sets two share a name with a chance of 5 %, and would count as equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exactdiff.llm.common import BROADCAST_ROWS, broadcast_if_small, counted, cut, cut_narrow, forget, release
from exactdiff.llm.components import connected_components
from exactdiff.llm.words import SPACED, buffers, hashed, mix, shingles

SKETCH_BITS = 20
_PART = 1 << 14
#: Lists of more entries give hub groups instead of pairs.
SHORT = 8
BLOCK = 512
#: Pivots of a hub, about, and the nodes that one task compares with them.
PIVOTS, CHUNK = 16, 256
#: Tokens of sets that are verified together against one set, about.
TOGETHER = 1 << 20
#: Tokens of a block's matrix at a time.
_COLUMNS = 4096
#: The largest l as a part of the set, and what a verification costs in list entries.
LONGEST, VERIFY = 0.04, 20
#: A token counted so many times more than the mean counter goes to its hub directly, as its list must be long.
HOT = 6
#: Parity bits of a set: the power of two from its size on, but so many at least.
BITS = 1024
FINE = 8
_ROWS = 400
_SALT = np.uint64(0x2545F4914F6CDD1D)


def least_overlap(n: int, percent: int) -> int:
    """A set of n tokens links only with sets that share at least so many."""
    return -(-percent * n // 100)


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for at in range(0, len(batch), _ROWS):
        part = batch.slice(at, _ROWS)
        raw, offsets = buffers(part.column("text"))
        h, row, _, _ = hashed(raw, offsets, SPACED)
        yield at, shingles(h, row, len(part), width)
    release()


def _node(s: np.ndarray) -> int:
    """The name of a set: a 63-bit hash of its sorted tokens."""
    with np.errstate(over="ignore"):
        total = mix(s).sum(dtype=np.uint64) * np.uint64(3) + mix(s ^ _SALT).sum(dtype=np.uint64) + np.uint64(len(s))
    return int(mix(np.array([total], np.uint64))[0] >> np.uint64(1))


def count_tokens(docs: DataFrame, width: int) -> np.ndarray:
    """Counters of all sets' tokens by their top bits; a table of fixed size, summed by the executors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for b in batches:
            for _, sets in _sets(b, width):
                if sets:
                    total += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total)).astype(np.uint32)
        if total.any():
            parts = total.reshape(-1, _PART)
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(len(parts)), pa.int32()), "counts": pa.array([x.tobytes() for x in parts], pa.binary())})

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_PART, np.uint64)
        for b in batches:
            for x in b.column("counts"):
                total += np.frombuffer(x.as_buffer(), np.uint32)
        yield pa.RecordBatch.from_pydict({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})

    found = docs.select("text").mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect()
    out = np.zeros((1 << SKETCH_BITS) // _PART * _PART, np.uint32).reshape(-1, _PART)
    for x in found:
        out[x.part] = np.frombuffer(x.counts, np.uint32)
    return out.reshape(-1)


def _lengthen(counts: np.ndarray, n: int, percent: int, floor: float) -> int:
    """The l whose prefix costs least: entries, and candidates that share at least l of them. counts: of the tokens
    from rare to frequent; floor: what a counter holds of unrelated tokens."""
    base = n - least_overlap(n, percent)
    most = max(1, min(int(LONGEST * n), n - base, _ELL))
    k = np.arange(1, most + 1)
    met = np.cumsum(np.maximum(counts[: base + most] - floor, 0.0))[base : base + most]
    return 1 + int(np.argmin(base + k + met * (1 + VERIFY / k)))


def _parity(s: np.ndarray, times: int = 1) -> bytes:
    """Bit i is whether an odd number of the set's tokens fall on i; times: how many times as many bits."""
    n = times * max(BITS, 1 << (len(s) - 1).bit_length()) if len(s) else BITS
    return np.packbits(np.bincount((s & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1).tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Rows of parity bits, as 64-bit words, over fewer bits: those of the same sets."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def named_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (the set's size), node (its name, null if empty), bits (its parity bits) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, sets in _sets(b, width):
                n, node = [len(s) for s in sets], [_node(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(sets)), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(list(map(_parity, sets)), pa.binary())], names=["doc_id", "n", "node", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, node long, bits binary")


#: An entry's info: size of the set, 12 bits of l, 21 bits of the token's position (the last stands for any behind it).
_ELL, _POSITION = (1 << 12) - 1, (1 << 21) - 1
_SEEN = 1 << 17


def prefixes(docs: DataFrame, width: int, percent: int, counters: np.ndarray) -> DataFrame:
    """token, node, info, hot: an entry for each token of each set's prefix. A task leaves out sets that it has just
    had, so that copies are combined before anything is shuffled; what copies remain are dropped in the lists."""
    shared = docs.sparkSession.sparkContext.broadcast(counters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = shared.value
        floor = float(count.mean())
        hot_from = HOT * floor + 1000
        seen: set[int] = set()
        for b in batches:
            for _, sets in _sets(b, width):
                tokens, nodes, infos, hot = [], [], [], []
                for s in sets:
                    if not len(s) or (node := _node(s)) in seen:
                        continue
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(node)
                    c = count[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    order = np.argsort(c, kind="stable")
                    c = c[order]
                    k = _lengthen(c, len(s), percent, floor)
                    p = len(s) - least_overlap(len(s), percent) + k
                    tokens.append(s[order[:p]].view(np.int64))
                    nodes.append(np.full(p, node))
                    infos.append((len(s) << 33 | k << 21) + np.minimum(np.arange(p), _POSITION))
                    hot.append(c[:p] >= hot_from)
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, nodes, infos, hot)], names=["token", "node", "info", "hot"])

    return docs.select("text").mapInArrow(run, "token long, node long, info long, hot boolean")


def _size(info):
    return info >> 33


def _ell(info):
    return info >> 21 & _ELL


def _shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries sorted by token, l and node, each once, those whose token more than one node has, with the least l that
    any of them has, which is the first one's."""
    held: tuple[np.ndarray, ...] | None = None  # the last entry, the least l of its token, whether the one before it has it

    def batch(cols: tuple[np.ndarray, ...], least: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (*cols, least)], names=["token", "node", "info", "least"])

    for b in batches:
        cols = tuple(b.column(k).to_numpy(zero_copy_only=False) for k in ("token", "node", "info"))
        if not len(cols[0]):
            continue
        before, known = False, None
        if held is not None:
            cols, known, before = tuple(np.concatenate(x) for x in zip(held[:3], cols)), int(held[3][0]), bool(held[4][0])
        new = np.concatenate(([True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])))
        cols = tuple(x[new] for x in cols)
        same = cols[0][1:] == cols[0][:-1]
        starts = np.concatenate(([True], ~same))
        least = _ell(cols[2])[starts]
        if known is not None:
            least[0] = known
        least = least[np.cumsum(starts) - 1]
        keep = np.concatenate(([before], same)) | np.concatenate((same, [False]))
        held = (*(x[-1:] for x in cols), least[-1:], np.array([same[-1] if len(same) else before]))
        keep[-1] = False
        yield batch(cols, least, keep)
    if held is not None and held[4][0]:
        yield batch(held[:3], held[3], np.array([True]))


_MET = "a long, b long, need int, rest long, overlap long"


def _meet(percent: int):
    """Over entries sorted by token and node, SHORT of a token at most: of each pair of a token's nodes whose sizes allow
    a link, the prefix tokens that they must share, what either has behind this token at most, the overlap they need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # entries of the last token seen
        for batch in chain(batches, [None]):
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("token", "node", "info")] if batch is not None else [x[:0] for x in held]
            if held:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            if not cols or not len(cols[0]):
                continue
            last = int(np.searchsorted(cols[0], cols[0][-1])) if batch is not None else len(cols[0])
            held = [x[last:] for x in cols]
            token, node, info = (x[:last] for x in cols)
            size, ell, behind = _size(info), _ell(info), _size(info) - (info & _POSITION) - 1
            for step in range(1, SHORT):
                i = np.flatnonzero(token[step:] == token[:-step])
                if not len(i):
                    break
                j = i + step
                ok = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
                i, j = i[ok], j[ok]
                found = node[i], node[j], np.minimum(ell[i], ell[j]).astype(np.int32), np.minimum(behind[i], behind[j]), _needed(size[i], size[j], percent)
                yield pa.RecordBatch.from_arrays(list(map(pa.array, found)), names=["a", "b", "need", "rest", "overlap"])

    return run


class _Forest:
    """Union-find over positions; join() says whether two trees became one."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _forest(nodes: list[int], sets: list[np.ndarray], left: int, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the first `left` sets and the rest; among all of them if left is 0."""
    tokens = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(tokens, return_inverse=True, return_counts=True)
    keep = times[column] > 1
    names, column = np.unique(column[keep], return_inverse=True)
    row = row[keep]
    top, low = (slice(0, left), slice(left, len(sets))) if left else (slice(0, len(sets)), slice(0, len(sets)))
    size = np.array([len(s) for s in sets])
    both = np.zeros((len(size[top]), len(size[low])), np.float32)
    for c in range(0, len(names), _COLUMNS):
        here = (column >= c) & (column < c + _COLUMNS)
        m = np.zeros((len(sets), min(_COLUMNS, len(names) - c)), np.float32)
        m[row[here], column[here] - c] = 1
        both += m[top] @ m[low].T
    whole = both.astype(np.int64)
    linked = 100 * whole >= percent * (size[top][:, None] + size[low][None, :] - whole)
    tree, out = _Forest(len(sets)), []
    for i, j in zip(*np.nonzero(linked)):
        i, j = int(i), int(j) + left
        if i != j and tree.join(i, j):
            out.append((nodes[i], nodes[j]))
    return out


def set_rows(docs: DataFrame, wanted: DataFrame, width: int, bits: int = 0) -> DataFrame:
    """node, tokens (binary) of the wanted nodes; instead of tokens parity bits, `bits` times as many as else, if bits
    is not 0. wanted: node, doc_id of one document that has the set. A node comes more than once if rows of that doc_id
    repeat."""
    some = docs.select("doc_id", "text").join(broadcast_if_small(wanted.select("doc_id").distinct()), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, sets in _sets(b, width):
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([_parity(s, bits) if bits else s.tobytes() for s in sets], pa.binary())], names=["node", "tokens"])

    return some.mapInArrow(run, "node long, tokens binary")


def _needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection with which sets of sizes n and m link."""
    return -(-percent * (n + m) // (100 + percent))


def _words(bits: bytes) -> np.ndarray:
    return np.frombuffer(bits, np.uint64)


def _possible(percent: int):
    """Of pairs (a, b, n and bits of both) those whose bits leave room for a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                apart = []
                for s, t in zip(batch.column("s"), batch.column("t")):
                    x, y = _words(s.as_buffer()), _words(t.as_buffer())
                    size = min(len(x), len(y))
                    apart.append(int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum()))
                n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
                keep = pa.array(n + m - np.array(apart) >= 2 * _needed(n, m, percent))
                yield pa.RecordBatch.from_arrays([x.filter(keep) for x in (*(batch.column(k) for k in ("a", "b", "n", "m")), pa.array(apart, pa.int64()))], names=["a", "b", "n", "m", "apart"])

    return run


def _apart(first: pd.Series, second: pd.Series) -> np.ndarray:
    """How many tokens the sets of any two rows differ in at least, by their bits."""
    out = np.zeros((len(first), len(second)), np.int64)
    lengths = [s.map(len).to_numpy() // 8 for s in (first, second)]
    for a in np.unique(lengths[0]):
        for b in np.unique(lengths[1]):
            i, j = np.flatnonzero(lengths[0] == a), np.flatnonzero(lengths[1] == b)
            x, y = (_folded(_words(b"".join(s.iloc[k])).reshape(len(k), -1), min(a, b)) for s, k in ((first, i), (second, j)))
            for k, row in zip(i, x):
                out[k, j] = np.bitwise_count(y ^ row).sum(1, dtype=np.int64)
    return out


def _room(first: pd.DataFrame, second: pd.DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether bits leave room for a link between any two rows, and how far they are apart at least."""
    apart = _apart(first["bits"], second["bits"])
    n, m = first["n"].to_numpy()[:, None], second["n"].to_numpy()[None, :]
    return (n + m - apart >= 2 * _needed(n, m, percent)) & (first["node"].to_numpy()[:, None] != second["node"].to_numpy()[None, :]), apart


def _to_pivots(percent: int):
    """Pairs of a chunk of a hub's nodes with pivots: each node with the nearest, and pivots with one another."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pivots, members = pdf[pdf["pivot"]], pdf[~pdf["pivot"]]
        if not len(pivots) or not len(members):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        room, apart = _room(members, pivots, percent)
        far = np.where(room, apart, np.iinfo(np.int64).max)
        keep = np.zeros_like(room)
        keep[np.arange(len(members)), far.argmin(1)] = True
        keep |= np.isin(members["node"].to_numpy(), pivots["node"].to_numpy())[:, None]
        i, j = np.nonzero(keep & room)
        a, b = members["node"].to_numpy()[i], pivots["node"].to_numpy()[j]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _nearest_apart(percent: int):
    """Pairs of a pair of blocks whose bits leave room for a link: each node and the nearest of another component."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        first, second = pdf[pdf["block"] == i], pdf[pdf["block"] == j]
        out = set()
        if len(first) and len(second):
            room, apart = _room(first, second, percent)
            ok = room & (first["component"].to_numpy()[:, None] != second["component"].to_numpy()[None, :])
            far = np.where(ok, apart, np.iinfo(np.int64).max)
            x, y = first["node"].tolist(), second["node"].tolist()
            pairs = [(k, int(far[k].argmin())) for k in np.flatnonzero(ok.any(1))] + [(int(far[:, k].argmin()), k) for k in np.flatnonzero(ok.any(0))]
            out = {(min(x[k], y[m]), max(x[k], y[m])) for k, m in pairs}
        return pd.DataFrame(sorted(out), columns=["a", "b"]).astype("int64")

    return run


def _possible_in_block(percent: int):
    """hub, node, component, block, i, j: the nodes of a pair of blocks whose bits leave room for a link with one of the other block
    that lies in another component."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        first, second = ((pdf["block"] == x).to_numpy() for x in (i, j))
        keep = np.zeros(len(pdf), bool)
        if first.any() and second.any():
            ok = _room(pdf[first], pdf[second], percent)[0] & (pdf["component"].to_numpy()[first][:, None] != pdf["component"].to_numpy()[second][None, :])
            keep[np.flatnonzero(first)[ok.any(1)]] = True
            keep[np.flatnonzero(second)[ok.any(0)]] = True
        return pdf.loc[keep, ["hub", "node", "component", "block", "i", "j"]]

    return run


def _verify(percent: int):
    """The links between one set, of the row whose leaf is the center itself, and others."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        center = (pdf["leaf"] == pdf["center"]).to_numpy()
        out = []
        if center.any():
            whole = np.frombuffer(pdf["tokens"][center].iloc[0], np.uint64)
            for leaf, raw in zip(pdf["leaf"][~center], pdf["tokens"][~center]):
                s = np.frombuffer(raw, np.uint64)
                at = np.minimum(np.searchsorted(whole, s), len(whole) - 1)
                both = int((whole[at] == s).sum())
                if 100 * both >= percent * (len(whole) + len(s) - both):
                    out.append((int(pdf["center"].iloc[0]), leaf))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def _verified(docs: DataFrame, named: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b, n, m) that link, as a and b. Pairs are dealt by the node of them that has more pairs, and its
    pairs again into parts of about TOGETHER tokens."""
    few = counted(pairs) <= BROADCAST_ROWS // 2  # then so are their nodes, and all rows below but those of sets
    degree = cut_narrow(pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("pairs")), few)
    sets = _sets_of(docs, named, degree.select("node"), width, few=few)
    many = 0 if few else counted(degree)
    of = lambda node, name: broadcast_if_small(degree.select(F.col("node").alias(node), F.col("pairs").alias(name)), many)
    first = F.struct("x", "a") >= F.struct("y", "b")
    named = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("center"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("leaf"), F.when(first, F.col("m")).otherwise(F.col("n")).alias("n"))
    named = cut_narrow(named, few)
    parts = cut_narrow(named.groupBy("center").agg(F.ceil(F.sum("n") / TOGETHER).alias("parts")), few)
    dealt = cut_narrow(named.join(broadcast_if_small(parts, 0 if few else None), "center").select("center", "leaf", F.pmod(F.xxhash64("leaf"), "parts").cast("int").alias("part")), few)
    wanted = dealt.select(F.col("leaf").alias("node"), "center", "part", "leaf").union(dealt.select(F.col("center").alias("node"), "center", "part", F.col("center").alias("leaf")).distinct())
    return cut(sets.join(broadcast_if_small(wanted, 0 if few else None), "node").select("center", "part", "leaf", "tokens").groupBy("center", "part").applyInPandas(_verify(percent), "a long, b long"))


def _compare(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        pdf = pdf.sort_values(["block", "node"])
        sets = [np.frombuffer(x, np.uint64) for x in pdf["tokens"]]
        left = 0 if i == j else int((pdf["block"] == i).sum())
        if i != j and left in (0, len(pdf)):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        return pd.DataFrame(_forest(pdf["node"].tolist(), sets, left, percent), columns=["a", "b"]).astype("int64")

    return run


def _pivot_pairs(groups: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """a, b: each node of a hub with one of the hub's pivots, where bits leave room for a link. groups: hub, node."""
    sizes = cut_narrow(groups.groupBy("hub").agg(F.count("*").alias("c")))
    dealt = groups.join(broadcast_if_small(sizes), "hub").withColumn("chunks", F.ceil(F.col("c") / CHUNK))
    pivot = (F.pmod(F.xxhash64(F.lit(1), "node"), F.col("c")) < PIVOTS) | (F.col("node") == F.col("hub"))
    members = dealt.select("hub", "node", F.pmod(F.xxhash64("node"), "chunks").alias("chunk"), F.lit(False).alias("pivot"))
    pivots = dealt.where(pivot).select("hub", "node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("pivot"))
    return named.select("node", "n", "bits").join(broadcast_if_small(cut_narrow(members.union(pivots))), "node").groupBy("hub", "chunk").applyInPandas(_to_pivots(percent), "a long, b long")


def _blocks(groups: DataFrame, percent: int) -> DataFrame:
    """hub, node, component, block, i, j: a row for each pair of blocks (i <= j) of a hub that a node takes part in.
    groups: hub, node, n, component and open, whether the node lies outside the hub's largest component; two blocks
    without such nodes do not meet. Blocks are ranges of set size that hold about BLOCK nodes: equal sizes are dealt by
    hash; those of open nodes have odd numbers."""
    sizes = groups.groupBy("hub", "open", "n").agg(F.count("*").alias("c"))
    # every size of a hub is one row here, so that a hub of any number of documents has few rows to order
    w = Window.partitionBy("hub", "open").orderBy("n")
    first = F.floor(F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / BLOCK)
    last = F.floor((F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1) / BLOCK)
    spread = sizes.select("hub", "open", "n", first.alias("first"), last.alias("last"))
    number = F.col("first") + F.pmod(F.xxhash64("node"), F.col("last") - F.col("first") + 1)
    dealt = groups.join(spread, ["hub", "open", "n"]).withColumn("block", (2 * number + F.col("open").cast("int")).cast("int"))
    ranges = dealt.groupBy("hub", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = ranges.select("hub", F.col("block").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    # a hub has few blocks; those of which no two sets can link drop out
    meet = ranges.join(other, "hub").where(f"(block % 2 = 1 or other % 2 = 1) and 100 * least(high, high2) >= {percent} * greatest(low, low2)")
    meet = meet.select("hub", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).distinct()
    return dealt.join(meet, ["hub", "block"]).select("hub", "node", "component", "block", "i", "j")


def _apart_in_hubs(groups: DataFrame, tied: DataFrame) -> DataFrame:
    """groups' rows of hubs with nodes of several components, with component and open."""
    labelled = cut_narrow(groups.join(tied, "node", "left").select("hub", "node", "n", F.coalesce("component", "node").alias("component")))
    each = labelled.groupBy("hub", "component").agg(F.count("*").alias("c"))
    several = each.groupBy("hub").agg(F.count("*").alias("parts"), F.max(F.struct("c", "component")).alias("most")).where("parts > 1")
    several = broadcast_if_small(cut_narrow(several.select("hub", F.col("most.component").alias("largest"))))
    return labelled.join(several, "hub").select("hub", "node", "n", "component", (F.col("component") != F.col("largest")).alias("open"))


def links(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The documents with their nodes (doc_id, n, node), and for each node that links with another its component among
    nodes (node, component). docs: doc_id, text; any further columns are left out."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    counters = count_tokens(docs, width)
    rows = cut(named_sets(docs, width))
    entry = prefixes(docs, width, percent, counters)
    listed = lambda x, *within: x.select("token", "node", "info").repartition("token").sortWithinPartitions("token", *within, "node")
    ell = F.shiftright("info", 21).bitwiseAND(F.lit(_ELL).cast("long"))
    shared = listed(entry.where("not hot"), ell).mapInArrow(_shared_only, "token long, node long, info long, least long")
    hot = cut(entry.where("hot").select("token", "node", "info").distinct())
    hot = hot.join(broadcast_if_small(cut(hot.groupBy("token").agg(F.min(ell).alias("least")))), "token").select("token", "node", "info", "least")
    # a partner of smaller l needs that many shared tokens only, so the least l among a token's nodes decides; a node's
    # entries meet once, and no more than its prefix
    own = Window.partitionBy("node")
    met = shared.union(hot).select("token", "node", "info", F.count("*").over(own).alias("c"), F.min("least").over(own).alias("ell"), F.max(ell).over(own).alias("own"))
    live = cut(met.where("c >= least(ell, own)").select("token", "node", "info", "c"))
    long_lists = broadcast_if_small(cut(live.groupBy("token").agg(F.count("*").alias("entries")).where(F.col("entries") > SHORT).select("token")))
    long_entries = cut_narrow(live.join(long_lists, "token"))
    hubs = cut_narrow(long_entries.groupBy("token").agg(F.max(F.struct("c", "node")).alias("x")).select("token", F.col("x.node").alias("hub")))
    pairs = listed(live.join(long_lists, "token", "left_anti")).mapInArrow(_meet(percent), _MET)
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("need").alias("need"), F.min("rest").alias("rest"), F.max("overlap").alias("overlap"))
    pairs = cut_narrow(pairs.where("shared >= need and shared + rest >= overlap").select("a", "b"))
    groups = cut_narrow(long_entries.join(broadcast_if_small(hubs), "token").groupBy("hub", "node").agg(F.first(F.shiftright("info", 33)).alias("n")))
    met = cut_narrow(pairs.select(F.explode(F.array("a", "b")).alias("node")).union(groups.select("node")).distinct())
    named = rows.where("node is not null").join(broadcast_if_small(met), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    named = cut(named)
    of = lambda node, n, bits: named.select(F.col("node").alias(node), F.col("n").alias(n), F.col("bits").alias(bits))
    del entry, shared, hot, met, live, long_lists, long_entries, hubs  # their shuffle files may go
    forget(docs.sparkSession)
    pairs = pairs.union(_pivot_pairs(groups.select("hub", "node"), named, percent)).distinct()
    pairs = cut_narrow(broadcast_if_small(cut_narrow(pairs)).join(of("a", "n", "s"), "a").join(of("b", "m", "t"), "b").mapInArrow(_possible(percent), "a long, b long, n long, m long, apart long"))
    least_pairs = cut_narrow(pairs.groupBy("b").agg(F.min(F.struct("apart", "a", "n", "m")).alias("x")).select("x.a", "b", "x.n", "x.m"))
    found = _verified(docs, named, least_pairs, width, percent)
    tied = cut_narrow(connected_components(found))
    forget(docs.sparkSession)
    rest = pairs.join(tied.toDF("a", "x"), "a", "left").join(tied.toDF("b", "y"), "b", "left").where("not coalesce(x, a) <=> coalesce(y, b)").join(least_pairs, ["a", "b"], "left_anti").select("a", "b", "n", "m")
    kept = "hub long, node long, component long, block int, i int, j int"
    for whole in (False, True):
        blocks = cut_narrow(_blocks(_apart_in_hubs(groups, tied), percent))
        in_blocks = named.select("node", "n", "bits").join(broadcast_if_small(blocks), "node").groupBy("hub", "i", "j")
        if not whole:
            some = cut_narrow(in_blocks.applyInPandas(_nearest_apart(percent), "a long, b long").distinct())
            some = cut_narrow(some.join(of("a", "n", "s").drop("s"), "a").join(of("b", "m", "t").drop("t"), "b").select("a", "b", "n", "m").union(rest).distinct())
            if some.isEmpty():
                break
            # most of them do not link: the same bits, but more of them, come before whole sets
            fine = _sets_of(docs, named, some.select(F.explode(F.array("a", "b")).alias("node")), width, FINE).dropDuplicates(["node"])
            some = broadcast_if_small(some).join(fine.toDF("a", "s"), "a").join(fine.toDF("b", "t"), "b")
            some = cut_narrow(some.mapInArrow(_possible(percent), "a long, b long, n long, m long, apart long").drop("apart"))
            found, tied = _more(found, tied, _verified(docs, named, some, width, percent))
        else:
            blocks = cut_narrow(in_blocks.applyInPandas(_possible_in_block(percent), kept))
            # the same with more bits, which only these few nodes need
            fine = _sets_of(docs, named, blocks.select("node"), width, FINE).dropDuplicates(["node"]).withColumnRenamed("tokens", "bits")
            blocks = cut_narrow(blocks.join(fine, "node").join(named.select("node", "n"), "node").groupBy("hub", "i", "j").applyInPandas(_possible_in_block(percent), kept))
            if not blocks.isEmpty():
                compared = _sets_of(docs, named, blocks.select("node"), width).join(broadcast_if_small(blocks), "node").groupBy("hub", "i", "j").applyInPandas(_compare(percent), "a long, b long")
                found, tied = _more(found, tied, cut(compared))
    return rows.select("doc_id", "n", "node"), tied


def _more(found: DataFrame, tied: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links with more of them, and the components of all."""
    if more.isEmpty():
        return found, tied
    found = found.union(more)
    tied = cut_narrow(connected_components(found))
    forget(found.sparkSession)
    return found, tied


def _sets_of(docs: DataFrame, named: DataFrame, nodes: DataFrame, width: int, bits: int = 0, few: bool = False) -> DataFrame:
    """set_rows of nodes, which may repeat; few: whether they are known to be few rows in few partitions."""
    nodes = nodes.distinct() if few else cut_narrow(nodes.distinct())
    wanted = named.join(broadcast_if_small(nodes, 0 if few else None), "node", "left_semi").select("node", "doc_id")
    return cut(set_rows(docs, cut_narrow(wanted), width, bits))


def join_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that is reachable by links, itself included) of each row."""
    rows, tied = links(docs, width, percent)
    of_node = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    labelled = of_node.join(tied, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    low = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    named = labelled.join(low, "component").select("node", "component_id")
    empty = rows.where("node is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.where("node is not null").join(named, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(empty)
