import random

import pytest
from pyspark.sql import functions as F

from exactdiff.errors import HardFail
from exactdiff.operators import pages, snapshots, suggest, summary
from exactdiff.operators.diff import Diff, Side
from exactdiff.streaming import refresh

LEFT = [("1", "2020", "Y", "1"), ("2", "2020", "Y", "1"), ("3", "2021", "N", "0"), ("4", "2021", "N", "x")]
RIGHT = [("1", "2020", "Yes", "1"), ("2", "2020", "Yes", "1"), ("3", "2021", "No", "0"), ("5", "2021", "N", "y")]
HEADERS = ["id", "year", "Status", "Flag"]


@pytest.fixture
def static(side):
    return Diff(side(HEADERS, *LEFT), side(HEADERS, *RIGHT), ["id", "year"])


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_static_pair(static):
    assert static.matched.count() == 3
    assert rows(static.named(static.mismatches)) == [("1", "2020", "Status", "Y", "Yes"), ("2", "2020", "Status", "Y", "Yes"), ("3", "2021", "Status", "N", "No")]
    assert rows(static.only_named("A")) == [LEFT[3]] and rows(static.only_named("B")) == [RIGHT[3]]
    assert rows(summary.pair_groups(static.mismatches)) == [("Status", "N", "No", 1), ("Status", "Y", "Yes", 2)]
    assert rows(summary.top_pairs(summary.pair_groups(static.mismatches))) == [("Status", "Y", "Yes", 2)]
    assert rows(summary.column_constants(static)) == [("Flag", None, None), ("Status", None, None)]
    assert rows(summary.equal_counts(static)) == [("Flag", 3), ("Status", 0)]


def test_exact_text_and_null(side):
    d = Diff(side(["id", "val"], ("1", None), ("2", "null"), ("3", "a "), ("4", "A")), side(["id", "val"], ("1", ""), ("2", ""), ("3", "a"), ("4", "a")), ["id"])
    assert [r[0] for r in rows(d.named(d.mismatches))] == ["2", "3", "4"]


@pytest.mark.parametrize("key", ["column", "val_a", "val_b", "k0", "a0", "in_a", "__date_a", "n"])
def test_hostile_key_names(side, key):
    d = Diff(side([key, "x.y`z", "K0"], ("1", "a", "p")), side([key, "x.y`z", "K0"], ("1", "b", "q")), [key])
    found = d.named(d.mismatches).collect()
    assert sorted((r["column"], r["val_a"], r["val_b"]) for r in found) == [("K0", "p", "q"), ("x.y`z", "a", "b")]
    assert d.classification().count() == 1


def test_case_sensitive_headers(side):
    d = Diff(side(["id", "ID", "id "], ("1", "a", "b")), side(["id", "id ", "Id"], ("1", "c", "d")), ["id"])
    assert d.comparable == ["id "] and d.extra_columns() == [("ID", "A"), ("Id", "B")]


def test_keys_that_fail(side):
    two = side(["id", "val"], ("1", "a"), ("1", "b"), ("0", "c"))
    with pytest.raises(HardFail, match=r"side A has the key \('1',\) on 2 rows"):
        Diff(two, two, ["id"]).check_keys()
    with pytest.raises(HardFail, match="side A lacks the key column 'nope'"):
        Diff(two, two, ["nope"])
    with pytest.raises(HardFail, match="side B has two columns named 'val'"):
        Diff(two, side(["id", "val", "val"], ("1", "a", "b")), ["id"])


def test_empty_rows_and_empty_keys(side):
    a = side(["id", "val"], ("", "a"), ("", ""), (None, None))
    assert a.frame.count() == 1
    Diff(a, a, ["id"]).check_keys()


def test_no_comparable_columns(side):
    d = Diff(side(["id"], ("1",)), side(["id", "x"], ("1", "2"), ("2", "3")), ["id"])
    assert d.mismatches.count() == 0 and d.only("B").count() == 1 and summary.column_constants(d).count() == 0


def test_against_plain_python(spark, side):
    r = random.Random(3)
    for _ in range(3):
        make = lambda: {(str(r.randrange(30)), str(r.randrange(2))): (r.choice("abc "), r.choice(["", "x", "1.0"])) for _ in range(40)}
        a, b = make(), make()
        d = Diff(side(["k", "l", "p", "q"], *(k + v for k, v in a.items())), side(["q", "p", "l", "k"], *((v[1], v[0], k[1], k[0]) for k, v in b.items())), ["k", "l"])
        want = sorted((*k, c, a[k][i], b[k][i]) for k in a.keys() & b.keys() for i, c in enumerate("pq") if a[k][i] != b[k][i])
        assert rows(d.named(d.mismatches)) == want
        assert rows(d.only("A").select("k0", "k1")) == sorted(a.keys() - b.keys())
        assert d.classification().count() == len(a.keys() | b.keys())


def test_constants_need_every_matched_row(side):
    d = Diff(side(["id", "s", "t"], ("1", "x", ""), ("2", "x", ""), ("9", "other", "o")), side(["id", "s", "t"], ("1", "x", "0"), ("2", "y", "0")), ["id"])
    assert rows(summary.column_constants(d)) == [("s", "x", None), ("t", "", "0")]
    assert rows(summary.constant_columns(summary.column_constants(d), d.mismatches, "A", "")) == [("t",)]


def test_union_pairs(side):
    h = ["id", "qty", "amt", "note"]
    d = Diff(side(h, ("1", "", "", "a"), ("2", "", "", "b")), side(h, ("1", "0", "0", "z"), ("2", "0", "0", "b")), ["id"])
    assert rows(summary.union_pairs(d.mismatches, ["qty", "amt"])) == [("", "0", 4, 2)]


def test_categorical_bounds(side):
    few = side(["id", "v"], *((str(i), f"a{i % 30}") for i in range(60)))
    d = Diff(few, side(["id", "v"], *((str(i), f"b{i % 20}") for i in range(60))), ["id"])
    assert summary.categorical(summary.pair_groups(d.mismatches)).first().categorical == "yes"
    d = Diff(few, side(["id", "v"], *((str(i), f"b{i % 21}") for i in range(60))), ["id"])
    assert tuple(summary.categorical(summary.pair_groups(d.mismatches)).first()) == ("v", 30, 21, 51, "no")


def test_context_counts_a_row_once(side):
    h = ["id", "val", "Flag"]
    a = [(str(i), "Y", f) for i, f in enumerate(["p", "p", "q", "r", "s", "t", "u", ""])]
    b = [(str(i), "Yes", f) for i, f in enumerate(["p", "z", "q", "r", "s", "t", "u", ""])]
    d = Diff(side(h, *a), side(h, *b), ["id"])
    found = summary.context_summary(d, "val", ["Flag"]).first()
    assert found.summary == "p×2 | (empty)×1 | q×1 | r×1 | s×1 | +3 more"
    two = summary.context_summary(d, "val", ["Flag", "val"]).first()
    assert two.summary.startswith("p|Y×2 | (empty)|Y×1 | (empty)|Yes×1")


def test_snapshots_and_refresh(side):
    h = ["id", "val"]
    a = side(h, ("1", "a"), ("2", "a"), ("3", "c"), ("7", "only"))
    first = Diff(a, side(h, ("1", "b"), ("2", "b"), ("3", "d")), ["id"])
    identity = snapshots.cell_identity(first)
    store, delta = snapshots.add(None, snapshots.of_pair(first.mismatches, "a", "b"), identity)
    assert delta.count() == 2 and snapshots.add(store, first.mismatches, identity)[1].count() == 1
    pending, accepted = snapshots.split(first.mismatches, store, identity)
    assert (pending.count(), accepted.count()) == (1, 2)
    now = Diff(a, side(h, ("1", "B"), ("2", "b"), ("3", "d")), ["id"])
    pending = snapshots.split(now.mismatches, store, identity)[0]
    assert rows(now.named(refresh.returned_cells(now, pending, store))) == [("1", "val", "a", "B")]
    assert snapshots.remove(store, first.mismatches, identity).count() == 0


def test_unmatched_identity_is_the_whole_row(side):
    d = Diff(side(["id", "v", "w"], ("1", "a", "b")), side(["id", "v", "w"], ("2", "a", "b")), ["id"])
    e = Diff(side(["id", "v"], ("1", "a")), side(["id", "v"], ("2", "a")), ["id"])
    store = snapshots.unmatched(d, "A")
    identity = snapshots.unmatched_identity(d)
    assert snapshots.split(snapshots.unmatched(d, "A"), store, identity)[0].count() == 0
    pending = snapshots.split(snapshots.unmatched(e, "A"), store, identity)[0]
    assert pending.count() == 1 and refresh.returned_keys(e, pending, store).count() == 1


def test_suggestions(side):
    a = side(["id", " ID-Cust ", "plain"], ("1", "x", "p"), ("2", "y", "p"), ("3", "z", "p"))
    d = Diff(a, side(["id", "cust_id", "else"], ("1", "x", "q"), ("2", "y", "q"), ("3", "w", "q")), ["id"])
    assert suggest.suggest(d) == [suggest.Suggestion(" ID-Cust ", "cust_id", ("strip", "case", "separators", "token sort"), 3, 1)]
    assert suggest.reasons("a_b", "a_b ") == ["strip"] and suggest.words("__") == ()


def test_pages(spark):
    df = spark.range(250).select(F.col("id").cast("string").alias("k0"))
    got, number, count = pages.page(df, ["k0"], 99)
    assert (number, count, len(got)) == (2, 3, 50)
    assert pages.after(df, ["k0"], ["98"]).first().k0 == "99" and pages.after(df, ["k0"], ["99"]).first().k0 == "99"
    assert pages.place(df, [("k0", True)], {"k0": "99"}) == 2
    with pytest.raises(ValueError):
        pages.page_frame(df, ["k0"], 0, 101)
    assert pages.page(df.limit(0), ["k0"], 5)[1:] == (0, 1)


def test_plans_have_one_join_and_no_cross_product(static):
    plan = static.mismatches._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join ") == 1 and "Cartesian" not in plan and "NestedLoop" not in plan


# ---- what is shuffled


def shuffled(spark, df):
    """Bytes that computing df shuffles."""
    context = spark.sparkContext._jsc.sc()

    def total():
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = total()
    df.write.format("noop").mode("overwrite").save()
    return total() - before


def long_rows(spark, gone, status="x"):
    """3,000 rows of about 500 bytes that no codec shortens, without some keys, as a side whose size Spark doesn't know."""
    text = F.concat(*(F.sha2(F.concat("id", F.lit(str(i))), 512) for i in range(4)))
    rows = spark.range(3000).where(F.col("id") % 100 != gone).select(F.col("id").cast("string").alias("id"), text.alias("text"), F.lit(status).alias("status"))
    return Side.of(spark.createDataFrame(rows.toArrow().to_pandas()))


@pytest.mark.parametrize("what", ["only", "returned_keys", "rows_marked"])
def test_rows_of_both_sides_are_not_shuffled_for_those_of_one(spark, what):
    a = long_rows(spark, 7)
    before, now = Diff(a, long_rows(spark, 8), ["id"]), Diff(a, long_rows(spark, 8, "y"), ["id"])
    store, rows = snapshots.unmatched(before, "B"), snapshots.unmatched(now, "B")
    made = {"only": lambda: now.only("B"), "returned_keys": lambda: refresh.returned_keys(now, rows, store), "rows_marked": lambda: refresh.rows_marked(now, rows, store)}[what]()
    assert made.count() == 30
    assert shuffled(spark, made) < 700_000  # the rows of one side have 1,500,000 bytes


def test_cells_are_split_without_a_shuffle_of_cells(spark, side):
    r = random.Random(5)
    made = lambda: [(str(i), r.choice("xy"), r.choice(["", "0", "x"]), r.choice("xy")) for i in range(60)]
    h = ["id", "p", "q", "r"]
    d = Diff(side(h, *made()), side(h, *made()), ["id"])
    identity = snapshots.cell_identity(d)
    # some as they are, some twice, some of another value, and a key that is gone
    stale = spark.createDataFrame([("1", "p", "old", "x"), ("1", "q", "old", "y"), ("none", "p", "x", "y")], "k0 string, column string, val_a string, val_b string")
    store = d.mismatches.where("k0 < '4'").union(d.mismatches.where("k0 < '2'")).union(stale)
    made, wanted = snapshots.split_cells(d, store), snapshots.split(d.mismatches, store, identity)
    for got, want in zip(made, wanted):
        assert rows(got.select(*identity)) == rows(want.select(*identity)) and got.count()
    lines = lambda df: [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x and "column#" in x]
    assert lines(wanted[0]) and not lines(made[0])
    added = snapshots.accepting(d, store, snapshots.is_pair("x", "y")).where("added").drop("added")
    assert rows(added.select(*identity)) == rows(snapshots.add(store, snapshots.of_pair(d.mismatches, "x", "y"), identity)[1])
