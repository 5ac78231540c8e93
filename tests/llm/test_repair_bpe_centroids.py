"""Conversation repair, byte-level BPE and centroid clustering against brute force, and all three through their queries."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from exactdiff.llm import bpe, centroids, turns

# ---- conversation repair

TURNS = "conv_id long, turn long, role string, text string"
LEGAL = re.compile("(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        fault = zlib.crc32(":".join(shown).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def digest(r):
    return hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()


def cheapest(rows):
    """By search over all edits, one at a time, in order of cost and letters."""
    seen, facts = set(), []
    for _, _, role, text in rows:
        core = re.sub("[\x20\x09-\x0d]", "", text)
        kind = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
        seen.add((role, text))
        facts.append((role, text, kind))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if i == len(facts) and LEGAL.fullmatch(roles):
            return cost, audit, "\n".join(out), facts
        state = i, roles[-1:]  # what may follow depends on the last role alone
        if state in done:
            continue
        done.add(state)
        allowed = lambda r: re.fullmatch("s?(ua)*u?", roles + r)  # noqa: E731, B023
        for r in ("user", "assistant"):
            if allowed(r[:1]):
                heapq.heappush(heap, (cost + 5, audit + "I", i, roles + r[:1], (*out, f"{r}:")))
        if i < len(facts):
            role, text, kind = facts[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles, out))
            if kind not in ("blank", "duplicate"):
                more = 5 if kind else 0
                if role[:1] and allowed(role[:1]):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + role[:1], (*out, f"{role}:{text}")))
                for r in ("user", "assistant"):
                    if allowed(r[:1]):
                        heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, roles + r[:1], (*out, f"{r}:{text}")))
    raise AssertionError


def expected(rows, harm=damaged):
    by_conv = {r[0]: [] for r in rows}
    for r in harm(rows):
        by_conv[r[0]].append(r)
    out = set()
    for conv, own in by_conv.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, digest(r)))
        cost, audit, text, facts = cheapest(own)
        dated = [r[1] for r in own if r[1] is not None]
        gaps = max(dated) - min(dated) + 1 - len(set(dated)) if dated else 0
        count = lambda kind: sum(f[2] == kind for f in facts)  # noqa: E731, B023
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(facts, facts[1:]))
        out.add((conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


def conversations(seed, n):
    r = random.Random(seed)
    texts = ["Yes.", "No", "Why? ", "", " \n", "Well. ", "so on ...", "a!", None, "é.", "a: b."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "uncle"]
    return [(r.choice([None, *range(n)]), r.choice([None, *range(9)]), r.choice(roles), r.choice(texts)) for _ in range(8 * n)]


def test_repair_against_search(spark, monkeypatch):
    monkeypatch.setattr(turns, "SEGMENT", 3)  # so that conversations cross many segments and levels
    rows = conversations(1, 40)
    found = turns.report(turns.damage(spark.createDataFrame(rows, TURNS)))
    assert {tuple(r) for r in found.collect()} == expected(rows) and found.count() == len({r[0] for r in rows})


def test_repair_of_one_long_conversation(spark):
    r = random.Random(3)
    rows = [(5, t, r.choice(["user", "assistant", "user", "assistant", "system"]), f"turn {r.randrange(700)}{r.choice(['.', '?', '', '!'])}") for t in range(1500)]
    frame = spark.createDataFrame(rows, TURNS)
    (found,) = turns.report(turns.plain(frame)).collect()
    assert tuple(found) == expected(rows, lambda x: x).pop()
    fixed = turns.repaired(turns.plain(frame), turns.audits(turns.tables(turns.placed(turns.faults(turns.plain(frame))))))
    kept = sorted(fixed.collect(), key=lambda x: x.place)
    assert LEGAL.fullmatch("".join(x.role[0] for x in kept)) and hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in kept).encode()).hexdigest() == found.repaired_sha256


def test_repair_of_odd_tables(spark):
    assert turns.report(turns.damage(spark.createDataFrame([], TURNS))).count() == 0
    dropped = next(t for t in range(100) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    fine = next(t for t in range(100) if zlib.crc32(f"2:{t}".encode()) % 20 > 4)
    rows = [(1, dropped, "user", "x"), *[(2, fine, "user", "Same.")] * 40, (2, fine, "assistant", "y" * 1_100_000 + ".")]
    extra = spark.createDataFrame([(*r, "z", 1) for r in rows], f"{TURNS}, segment string, place int")
    found = {r.conv_id: tuple(r) for r in turns.report(turns.damage(extra)).collect()}
    assert set(found.values()) == expected(rows)
    assert found[1] == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) and found[2][3] == 39


def test_repair_query(spark, tmp_path):
    rows = conversations(7, 60)
    spark.createDataFrame(rows, TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    found = entry.queries()["op11_conversation_repair"](spark, str(tmp_path))
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {tuple(r) for r in found.collect()} == expected(rows)


# ---- byte-level BPE


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.default_path()), special_tokens={})


def test_bpe_query_is_the_library_s(spark, table, odd, library, tmp_path):
    r = random.Random(5)
    letters = "aàb çdéelt'  \n\t日本ab12½٣ſ’—!?. \U0001f600\x85\x1c"
    rows = [*odd, *((100 + i, "".join(r.choice(letters) for _ in range(r.randrange(80)))) for i in range(300)), (900, "it's we'll 'S ''s \n's  \n\n x"), (901, "aaaaaaaaaaaaab" * 90_000), (902, " " * 5000 + "x")]
    table(rows).withColumnRenamed("source", "ids").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        want.append((doc_id or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    found = entry.queries()["op12_byte_bpe"](spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((x[0] or 0, *x[1:]) for x in found.collect()) == sorted(want)
    assert bpe.decode(bpe.encode(table([]))).count() == 0


def test_replay_where_parts_are_younger_than_the_whole():
    """Random ranks make merges that open lower ones; the plain rule is the leftmost pair of least rank."""
    r = random.Random(2)
    for _ in range(60):
        tokens = {bytes(r.choice(b"abc") for _ in range(r.randrange(2, 6))) for _ in range(40)}
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(r.sample(sorted(tokens), len(tokens)))}
        words = [bytes(r.choice(b"abc") for _ in range(r.randrange(1, 30))) for _ in range(60)] + [b"a" * 40, b"ab" * 30]
        for word, got in zip(words, bpe.Merges(ranks).replay(words)):
            parts = [bytes([b]) for b in word]
            while word not in ranks and len(parts) > 1:
                rank, at = min((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank == 1 << 30:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            assert got == ([ranks[word]] if word in ranks else [ranks[x] for x in parts])


def test_forgetting_words_changes_nothing(library, monkeypatch, prose):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    encoder = bpe.Encoder(bpe.merges_of(bpe.default_path()), bpe.default_pattern())
    for _ in range(4):
        texts = [prose(100), prose(3)]
        assert [x.tolist() for x in encoder.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_unknown_ids_do_not_decode(spark):
    ids = lambda *x: bytearray(np.array(x, "<u4").tobytes())
    assert [bytes(r.decoded) if r.decoded is not None else None for r in bpe.decode(spark.createDataFrame([(ids(),), (None,)], "ids binary")).collect()] == [b"", None]
    with pytest.raises(Exception, match="vocabulary"):
        bpe.decode(spark.createDataFrame([(ids(4_000_000_000),)], "ids binary")).collect()


# ---- centroid clustering


def lloyd(rows, k, rounds, scale, dimension):
    """Whole-number rounds by comparing each vector with each centroid."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and np.isfinite(x) for x in v)]
    hashed = sorted((i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "", np.array(v, "<i4").tobytes(), v) for i, v in kept)
    at = [v for *_, v in hashed[:k]]
    away = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    nearest = lambda v: min((away(v, c), j) for j, c in enumerate(at))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(at)):
            members = [v for (_, v), o in zip(kept, own) if o == j]
            if members:
                at[j] = [sum(x) // len(members) for x in zip(*members)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    inertia = {j: sum(d for _, c, d in found if c == j) for j in range(len(at))}
    return [(i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest()) for i, c, d in found]


VECTORS = "vec_id long, embedding array<float>, label int"


def some_vectors(seed, n, dimension, grid):
    r = np.random.default_rng(seed)
    v = r.integers(-3, 4, (n, dimension)) / 4 if grid else r.standard_normal((n, dimension)) + 4 * r.integers(0, 2, (n, 1))
    return [(int(i), [float(np.float32(x)) for x in row]) for i, row in enumerate(v)]


@pytest.mark.parametrize("grid", [True, False])
def test_clusters_against_plain_rounds(spark, grid):
    rows = some_vectors(4, 300, 3, grid)  # a small grid makes many ties and equal vectors
    rows += [(7, [1.0, 1.0, 1.0]), (None, [0.5, 0.5, 0.5]), (500, None), (501, [1.0, 2.0]), (502, [1.0, None, 0.0]), (503, [1.0, float("nan"), 0.0]), (504, [float("inf"), 0.0, 0.0])]
    frame = spark.createDataFrame([(*r, 0) for r in rows], VECTORS)
    for k, rounds in ((8, 10), (12, 14)):
        found = centroids.clusters(frame, k=k, rounds=rounds, dimension=3)
        order = lambda xs: sorted(xs, key=lambda x: (x[0] is None, x[0] or 0, *x[1:]))
        assert order(map(tuple, found.collect())) == order(lloyd(rows, k, rounds, 1024, 3))


def test_bounds_spare_distances():
    r = np.random.default_rng(1)
    middles = r.integers(-50_000, 50_000, (64, 16))
    x = (middles[r.integers(0, 64, 5000)] + r.integers(-300, 300, (5000, 16))).astype(np.int64)
    at, scanned = middles.astype(np.int64), []
    own, upper, lower, _ = centroids.assign(x, centroids.Centroids(at), np.zeros(5000, np.int32), np.full(5000, np.inf), np.zeros(5000))
    moved = at + r.integers(-20, 20, at.shape)
    found, _, _, _ = centroids.assign(x, centroids.Centroids(moved, at), own, upper, lower, scanned)
    plain = ((x[:, None, :] - moved[None]) ** 2).sum(2)
    assert (found == plain.argmin(1)).all()
    assert sum(scanned) < plain.size / 50


def test_clusters_of_odd_tables(spark):
    assert centroids.clusters(spark.createDataFrame([], VECTORS)).count() == 0
    rows = [(i, [float(i)] * 64, 0) for i in range(3)]
    found = centroids.clusters(spark.createDataFrame(rows, VECTORS)).collect()
    assert len({r.cluster for r in found}) == 3 and {r.distance for r in found} == {0}
    with pytest.raises(Exception, match="long"):
        centroids.clusters(spark.createDataFrame([(1, [1e30] * 64, 0)], VECTORS)).collect()


def test_clusters_query(spark, tmp_path):
    rows = some_vectors(9, 200, 64, False)
    spark.createDataFrame([(*r, 0, "x") for r in rows], f"{VECTORS}, cluster string").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = entry.queries()["op13_centroids"](spark, str(tmp_path))
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, found.collect())) == sorted(lloyd(rows, 8, 10, 1024, 64))
