import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from exactdiff.llm import mixing, nearest, packing, quality
from exactdiff.llm.tokens import Encoder, default_path

# ---- tokens and packing


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_path())
    return lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 2]


def test_tokens_are_the_library_s(ids, odd):
    texts = [t for _, t in odd] + ["it's 'S <|endoftext|> áb É Σς İ½²", "<|startoftext|>", "Große, schöne... Häuser!!"]
    assert [x.tolist() for x in Encoder(default_path(), 2).encode_column(pa.array(texts))] == [ids(t) for t in texts]


def test_forgetting_pieces_changes_nothing(ids, monkeypatch, prose):
    from exactdiff.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    e = Encoder(default_path(), 2)
    for _ in range(5):
        t = prose(200)
        assert e.encode(t).tolist() == ids(t)


def test_pieces_that_come_again_are_learned_once(ids, monkeypatch):
    from exactdiff.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 60)
    monkeypatch.setattr(tokens, "_pieces", {default_path(): tokens._Pieces()})
    e, learned, learn = Encoder(default_path(), 2), [], Encoder._learn
    monkeypatch.setattr(Encoder, "_learn", lambda self, pieces: learned.extend(pieces) or learn(self, pieces))
    name = lambda n: "".join(chr(97 + int(c)) for c in str(n))
    for k in range(20):
        t = " ".join(["often,", "abcdefgh", "abcdefghi", "Straßenbahnhöfe", *(f"x{name(100 * k + n)}" for n in range(20))])
        assert e.encode(t).tolist() == ids(t)
    assert [learned.count(x) for x in ("often,", "abcdefgh", "abcdefghi", "straßenbahnhöfe")] == [1, 1, 1, 1]
    assert len(learned) == 404 and tokens._pieces[default_path()].known <= 84  # the others have been forgotten


def test_forgetting_takes_little_more_than_the_table(monkeypatch):
    import tracemalloc

    from exactdiff.llm import tokens

    n, size = 60_000, 200
    h = np.arange(1, n + 1, dtype=np.uint64) << np.uint64(40)
    low = np.concatenate((np.arange(n * size, dtype=np.int64).astype(np.uint8), np.zeros(8, np.uint8)))
    begin = np.arange(n) * size
    held = tokens._Pieces()
    for lo in range(0, n, 5_000):
        some = slice(lo, lo + 5_000)
        held.put(h[some], [[i, i + 1] for i in range(lo, lo + 5_000)], low, begin[some], begin[some] + size)
    held.again.items[1:n] = True
    tracemalloc.start()
    held.forget()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6  # the places of all bytes at once take 288 MB
    number = held.find(h)
    assert held.known == n - 1 and number[0] == -1 and held.same(number[1:], low, begin[1:], begin[1:] + size).all()
    assert held.ids.items[held.at[0].items[number[-1]] :][:2].tolist() == [n - 1, n]


def test_a_piece_of_any_length_keeps_its_ids(ids):
    long = "7" * 1_048_581
    texts = ["one", "two", "three", f"before {long} behind"]
    e = Encoder(default_path(), 2)
    found = e.encode_column(pa.array(texts))
    assert e.by_piece and len(found[3]) > 1 << 20
    assert [x.tolist() for x in found] == [ids(t) for t in texts]


def test_hilbert_key_is_a_curve():
    for dims, bits in ((2, 4), (3, 3)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = packing.hilbert_key(cells, bits)
        assert sorted(key.tolist()) == list(range(side**dims))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_hilbert_pack(table, odd, ids):
    found = packing.hilbert_pack(table(odd), length=256).collect()
    texts = {}
    for i, t in odd:
        texts.setdefault(i, []).append(ids(t))
    assert sum(r.start == 0 for r in found) == len(odd)
    for r in found:
        own = np.frombuffer(r.ids, "<u4").tolist()
        assert len(own) == r.length and r.ids_crc32 == zlib.crc32(r.ids) and any(r.doc_tokens == len(x) and x[r.start : r.start + r.length] == own for x in texts[r.doc_id])
    assert sum(r.length for r in found) == sum(len(x) for xs in texts.values() for x in xs)
    used = {}
    for r in found:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256
    assert packing.hilbert_pack(table([])).count() == 0


def test_partitions_follow_the_curve_through_heavy_stretches(table, prose, monkeypatch):
    base = prose(400, punctuation=False).split()
    near = [" ".join(base[:i] + [f"word{i}"] + base[i + 1 :]) for i in range(300)]  # they share a cell, or nearly so
    rows = [(i, t) for i, t in enumerate([*near, *(prose(50) for _ in range(60)), *[near[0]] * 40])]
    size = sum(len(t.encode()) + 1 for _, t in rows)
    for each in (size // 12, size // 40):
        monkeypatch.setattr(packing, "PARTITION_BYTES", each)
        docs = table(rows)
        stretches, found, _ = packing.curve_stretches(docs)
        assert (stretches.bits < 32).any() and found.sum() == size
        dealt = packing.curve_order(docs).select("doc_id", "curve_key", F.octet_length("text").alias("n"), F.spark_partition_id().alias("p")).collect()
        assert sorted(r.doc_id for r in dealt) == [i for i, _ in rows]
        at = dict(zip([r.doc_id for r in dealt], stretches.of(np.array([r.curve_key for r in dealt])).tolist()))
        of_part = {}
        for r in dealt:
            of_part.setdefault(r.p, []).append(r)
        # a stretch that holds no more than a partition lies in one partition, and these follow each other along the curve
        light = [(min(at[r.doc_id] for r in some), max(at[r.doc_id] for r in some)) for _, some in sorted((p, [r for r in x if found[at[r.doc_id]] <= each]) for p, x in of_part.items()) if some]
        assert len(light) > 4 and all(a[1] < b[0] for a, b in zip(light, light[1:]))
        assert len({r.curve_key for r in dealt if found[at[r.doc_id]] > each}) <= 1  # that of the forty copies
        assert max(sum(r.n + 1 for r in x) for x in of_part.values()) <= 3 * each + 3000
    assert packing.hilbert_pack(table(rows), length=256).where("start = 0").count() == len(rows)


def test_neighbours_share_topics():
    raw = pa.array(["alpha beta gamma " * 30, "alpha beta gamma " * 31, "one two three four " * 30, None])
    from exactdiff.llm.words import buffers

    v = packing.vectors(*buffers(raw))
    assert np.linalg.norm(v[0] - v[1]) < np.linalg.norm(v[0] - v[2]) and not v[3].any()


def test_best_fit_is_best_fit_decreasing():
    r = np.random.default_rng(3)
    for _ in range(30):
        length = int(r.integers(1, 70))
        sizes = r.integers(1, length + 1, int(r.integers(0, 60))).tolist()
        rooms, want = [], []
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            fits = [x for x in rooms if x >= sizes[i]]
            if fits:
                rooms[rooms.index(min(fits))] -= sizes[i]
            else:
                rooms.append(length - sizes[i])
        placed = packing.best_fit(sizes, length)
        left = {}
        for n, (s, _) in zip(sizes, placed):
            left[s] = left.get(s, length) - n
        assert sorted(left.values()) == sorted(rooms)
        for s in left:
            parts = sorted((o, n) for n, (q, o) in zip(sizes, placed) if q == s)
            assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts]).tolist()[:-1]]


def test_best_fit_pack_and_files(table, odd, ids, tmp_path):
    packed = packing.best_fit_pack(table(odd), length=128)
    found = packed.collect()
    seen = {}
    for r in found:
        row, ends = np.frombuffer(r.ids, "<u4"), r.cumulative_lengths
        assert len(row) == 128 and ends[-1] == r.n_tokens <= 128 and r.position_resets == ends[:-1] and not row[r.n_tokens :].any() and r.n_segments == len(ends) - 1
        for d, start, a, b in zip(r.doc_ids, r.starts, ends, ends[1:]):
            seen.setdefault(d, []).append((start, row[a:b].tolist()))
    texts = {}
    for i, t in odd:
        texts.setdefault(i, []).append(ids(t))
    assert {d: sorted(x for _, part in parts for x in part) for d, parts in seen.items()} == {d: sorted(x for t in ts for x in t) for d, ts in texts.items()}
    assert [x for _, part in sorted(seen[8]) for x in part] == texts[8][0]
    packing.write_packed(packed, str(tmp_path / "out"))
    names = sorted(x.name for x in (tmp_path / "out").iterdir())
    matrix = np.concatenate([np.fromfile(tmp_path / "out" / x, "<u4") for x in names if x.startswith("ids")]).reshape(-1, 128)
    places = np.concatenate([np.fromfile(tmp_path / "out" / x, "<u4") for x in names if x.startswith("positions")]).reshape(-1, 128)
    assert len(matrix) == len(found) and all(x.endswith(".bin") for x in names) and ((places[:, 1:] == places[:, :-1] + 1) | (places[:, 1:] == 0)).all()


# ---- mixing


def test_raking_meets_its_targets(table, prose):
    rows = [(i, prose(5 + i % 40), ["en", "de", None][i % 3 if i % 5 else 0], f"s{i % 4 if i % 3 else 0}") for i in range(300)]
    df = table(rows)
    cells = mixing.measured(df).groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    goals = {m: mixing.targets(cells, m, p) for m, p in mixing.POWERS.items()}
    raked = mixing.rake(cells, goals)
    other = {(r.source, r.lang, r.topic): r.weight for r in mixing.rake(cells, goals, few=0, tolerance=1e-4).collect()}
    assert all(abs(other[r.source, r.lang, r.topic] / max(r.weight, 1e-9) - 1) < 1e-2 or r.weight == 0 for r in raked.collect()) and len(other) == raked.count()
    for m, goal in goals.items():
        off = raked.groupBy(m).agg(F.sum("weight").alias("w")).join(goal, m).select(F.max(F.abs(F.col("w") / F.col("goal") - 1))).first()[0]
        assert off < 1e-8
    found = mixing.calibrated(df, rate=0.5).collect()
    total = sum(r.tokens for r in found)
    assert len(found) == 300 and abs(sum(r.tokens * r.probability for r in found) / total - 0.5) < 0.02 and 0.35 < sum(r.tokens for r in found if r.sampled) / total < 0.65
    kept = mixing.sample(df.withColumn("probability", F.lit("clash")), rate=0.5)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in found if r.sampled} and kept.columns == [*df.columns, "probability"]


def test_raking_goes_on_until_correlated_margins_are_met(spark):
    cells = [(f"s{i}", f"l{i % 5}" if j == 0 else f"l{(i + j) % 5}", str(i % 4 if j == 0 else (i + j) % 4), (20 if i == 0 else 1) * (1000 if j == 0 else 7)) for i in range(40) for j in range(3)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long").groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    goals = {m: mixing.targets(df, m, p) for m, p in mixing.POWERS.items()}
    raked = mixing.rake(df, goals, most=1000)
    for m, goal in goals.items():
        assert raked.groupBy(m).agg(F.sum("weight").alias("w")).join(goal, m).select(F.max(F.abs(F.col("w") / F.col("goal") - 1))).first()[0] < 1e-7
    with pytest.warns(UserWarning, match="off its target"):
        mixing.rake(df, goals, most=2)


def test_mixing_edge_cases(table, odd):
    assert mixing.calibrated(table([])).count() == 0 and mixing.sample(table([])).count() == 0
    found = mixing.calibrated(table(odd)).collect()
    assert len(found) == len(odd) and all(0 <= r.probability <= 1 for r in found) and {r.tokens for r in found if r.doc_id in (1, 2, 3)} == {0}
    assert all(r.probability is not None for r in mixing.calibrated(table([(1, None), (2, "")])).collect())


# ---- quality


def test_quality(spark, table, prose):
    good = [(i, prose(80)) for i in range(120)]
    bad = [(200 + i, " ".join(w + "%%%" for w in prose(60).split())) for i in range(60)] + [(300 + i, "Spam spam " * 40) for i in range(60)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(9999, 1, 0), (1, None, None), (2, 7, 0)], "doc_id long, quality int, toxic int")
    df = table(good + bad)
    model = quality.train(df, labels)
    found = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert 0 < len(model.rules) and min(found[i] for i, _ in good) > max(found[i] for i, _ in bad)
    assert "Python" not in quality.score(df, model)._jdf.queryExecution().executedPlan().toString()


def test_quality_edge_cases(spark, table, odd):
    labels = spark.createDataFrame([(8, 1), (9, 1)], "doc_id long, quality int")
    for some in (labels, labels.limit(0)):
        model = quality.train(table(odd), some)
        found = quality.score(table(odd), model).collect()
        assert len(found) == len(odd) and all(0 <= r.score <= 1 for r in found)
    assert quality.score(table([]), model).count() == 0


def test_compiled_rules_are_the_fitted_ones(table, odd):
    x = np.random.default_rng(1).random((400, len(quality.STATISTICS)))
    model = quality.fit(x, ((x[:, 1] > 0.5) & (x[:, 3] < 0.7)).astype(float))
    df = table(odd).sparkSession.createDataFrame(x[:50].tolist(), [f"s_{k}" for k in quality.STATISTICS])
    got = [r[0] for r in df.select(model.expression()).collect()]
    want = [1 / (1 + np.exp(-(model.base + sum(w for w, rule in model.rules if quality._holds(row[None], rule)[0])))) for row in x[:50]]
    assert np.allclose(got, want)
    assert list(quality.statistics(F.lit("a"))) == quality.STATISTICS


# ---- nearest


def brute(rows, k, asks):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for n, (i, q) in enumerate(ok):
        if asks(i):
            s = sorted((-float(np.dot(x, q)), j) for j, x in ok if j != i and len(x) == len(q))
            out[i] = s[:k]
    return out


def test_recall_and_order(spark, monkeypatch):
    monkeypatch.setattr(nearest, "ROWS", 700)
    r = np.random.default_rng(8)
    x = r.standard_normal((2000, 24)) * r.uniform(0.5, 2, (2000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32).astype(float))]
    found = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=10).collect()
    want = brute(rows, 10, lambda i: i % 20 == 0)
    got = {}
    for f in sorted(found, key=lambda f: (f.query_id, f.rank)):
        got.setdefault(f.query_id, []).append(f)
    assert got.keys() == want.keys()
    hit = sum(len({f.vec_id for f in got[i]} & {j for _, j in want[i]}) for i in want)
    assert hit >= 0.9 * 10 * len(want)
    for i, fs in got.items():
        assert [f.rank for f in fs] == list(range(1, 11)) and [(-f.score, f.vec_id) for f in fs] == sorted((-f.score, f.vec_id) for f in fs)
        assert all(abs(f.score - np.dot(rows[f.vec_id][1], rows[i][1])) < 1e-9 for f in fs)


def test_nearest_edge_cases(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [1.0, None]), (5, [2.0, 0.0]), (6, [2.0, 0.0]), (None, [9.0, 9.0]), (8, [1.0, 1.0, 1.0]), (20, [0.0, 3.0]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = sorted(map(tuple, nearest.nearest(df.withColumn("score", F.lit(1)), F.col("vec_id") % 20 == 0, k=3).collect()))
    assert found == [(0, 1, 5, 2.0), (0, 2, 6, 2.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 5, 0.0), (20, 3, 6, 0.0)]
    assert nearest.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_few_rows_are_verified_and_the_nearest_are_among_them():
    r = np.random.default_rng(12)
    x = r.standard_normal((4000, 64))
    x[1000:1500] = x[1000]  # one common vector
    ids, q, verified = np.arange(len(x)), x[::50], []
    at, found, _ = nearest.search_block(ids, x, ids[::50], q, 20, float(np.sqrt((x * x).sum(1)).max()), verified)
    assert len(verified) == len(q) and sum(verified) < 0.25 * len(q) * len(x)
    score, hit = q @ x.T, 0
    score[np.arange(len(q)), ids[::50]] = -np.inf
    least = np.sort(score, axis=1)[:, -20]
    for i, j in zip(at, found):
        hit += score[i, j] >= least[i] - 1e-9
    assert hit >= 0.9 * 20 * len(q)


def test_a_repeated_query_row_asks_once(spark):
    rows = [(i, [float(i % 5), 1.0 + i]) for i in range(15)] + [(0, [0.0, 1.0])] * 3 + [(20, [1.0, 0.0]), (20, [0.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = nearest.nearest(df, F.col("vec_id") % 20 == 0, k=4).collect()
    own = sorted((f.rank, f.vec_id) for f in found if f.query_id == 0)
    assert own == [(1, 14), (2, 13), (3, 12), (4, 11)]
    other = sorted((f.rank, f.vec_id, f.score) for f in found if f.query_id == 20)
    assert [r for r, _, _ in other] == [1, 1, 2, 2, 3, 3, 4, 4]
    assert {(1, 4, 4.0), (1, 0, -1.0)} <= set(other)
