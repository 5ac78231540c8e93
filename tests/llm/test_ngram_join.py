import random
import re
from itertools import combinations

import pytest

from exactdiff.llm import components, ngram_join


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) or (frozenset([tuple(words)]) if words else frozenset())


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            up[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    low = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return sorted(((rows[i][0], len(sets[i]), low[root(i)]) for i in range(len(rows))), key=repr)


def got(df, **k):
    return sorted(map(tuple, ngram_join.join_components(df, **k).collect()), key=repr)


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80), (2, 50)])
def test_against_brute_force(table, prose, width, percent):
    r = random.Random(width)
    texts = [prose(r.choice([3, 12, 60, 150]), punctuation=False) for _ in range(12)]
    passage = prose(50)
    for t in list(texts):
        for _ in range(r.choice([1, 2, 15])):
            words = t.split()
            for _ in range(r.randrange(4)):
                words[r.randrange(len(words))] = f"edit{r.randrange(5)}"
            texts.append(" ".join(words) if r.random() < 0.8 else passage + " " + " ".join(words))
    rows = [(i, t) for i, t in enumerate(r.sample(texts, len(texts)))]
    assert got(table(rows), width=width, percent=percent) == brute(rows, width, percent)


def test_large_near_copy_group_in_blocks(table, prose, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    r, base = random.Random(5), prose(120, punctuation=False).split()
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(r.randrange(5)):
            words[r.randrange(len(words))] = f"e{r.randrange(1000)}"
        rows.append((i, " ".join(words)))
    assert got(table(rows), width=4, percent=85) == brute(rows, 4, 85)


def test_odd_rows(table, odd):
    assert got(table(odd), width=4, percent=85) == brute(odd, 4, 85)


def test_empty_table_and_clashing_columns(spark, table):
    assert got(table([]), width=4, percent=85) == []
    df = spark.createDataFrame([(1, "a b c d e", 9, 9, 9)], "doc_id int, text string, node long, token long, component_id long")
    assert got(df) == [(1, 1, 1)]


def test_every_length_of_prefix_gives_the_same_links(table, prose, monkeypatch):
    r = random.Random(2)
    rows = []
    for i in range(60):
        words = (prose(80, punctuation=False) if i % 6 == 0 else rows[-1][1]).split()
        words[r.randrange(len(words))] = f"w{i}"
        rows.append((i, " ".join(words)))
    for k in (1, 3, 12):
        monkeypatch.setattr(ngram_join, "_lengthen", lambda counts, n, percent, floor, k=k: max(1, min(k, n - (n - ngram_join.least_overlap(n, percent)))))
        assert got(table(rows), width=4, percent=85) == brute(rows, 4, 85)


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(7, 7), (None, 3), (200, 300), (200, 300)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for x in up}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
