"""Stores, kept counts, ordered pages, folders of text, text helpers, and what a session does with them."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from exactdiff.errors import ActionError, HardFail
from exactdiff.functions.checks import checked
from exactdiff.functions.text import constant_text, pair_text, top_text, visible, window
from exactdiff.operators import pages, roster, snapshots, summary
from exactdiff.operators.diff import Diff
from exactdiff.operators.store import Store, signed
from exactdiff.session import Place, Session
from exactdiff.sources import lines
from exactdiff.sources.load import source

# ---- stores and counts


def test_a_store_keeps_few_parts_and_a_plan_of_constant_size(spark):
    held, live, r = Store(("k",), ("n",)), set(), random.Random(4)
    size = {}
    for step in range(24):
        some = {str(r.randrange(40)) for _ in range(3)} if r.random() < 0.6 or not live else set(r.sample(sorted(live), min(2, len(live))))
        sign = 1 if some - live else -1
        some = some - live if sign == 1 else some
        held = held.plus(signed(spark.createDataFrame([(x,) for x in some], "k string"), ["k"], sign))
        live = live | some if sign == 1 else live - some
        if step in (11, 23):
            size[step] = len(held.parts)
            assert {x.k for x in held.current().collect()} == live
    assert max(size.values()) <= 6 and held.rows() == len(live)
    assert held.plus(spark.createDataFrame([], "k string, n long")) is held


def fields(seed, n=60):
    r = random.Random(seed)
    value = lambda: r.choice(["", "1", "01", "a", "A", " a", "2020-01-02", "20200102", "x y"])
    return [(str(i), value(), value(), value()) for i in range(n)]


def test_kept_counts_equal_a_full_recomputation(side):
    h = ["id", "p", "q", "r"]
    d = Diff(side(h, *fields(1)), side(h, *fields(2)), ["id"])
    identity = snapshots.cell_identity(d)
    counts, facts, store = roster.new_counts(roster.counted(d.mismatches, None, identity)), None, Store(tuple(identity), ("n",))
    facts = roster.facts(counts.current())
    r = random.Random(3)
    for step in range(5):
        accepting = step % 3 != 2
        pool = snapshots.split(d.mismatches, store.current(), identity)[0 if accepting else 1]
        where = F.col("column") == r.choice("pqr") if r.random() < 0.5 else F.col("k0").endswith(str(r.randrange(10)))
        delta = pool.where(where).select(*identity)
        delta = delta.sparkSession.createDataFrame(delta.collect(), delta.schema)
        facts = roster.after(facts, counts := roster.moved(counts, delta, accepting), delta)
        store = store.plus(signed(delta, identity, 1 if accepting else -1))
    full = roster.facts(roster.counted(d.mismatches, store.current(), identity))
    rows = lambda x: sorted(map(repr, x.collect()))
    assert rows(facts.select(*full.columns)) == rows(full)
    # untouched columns are not read again: the filter reaches the files
    plan = counts.current(F.col("column").isin(["p"]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(column), EqualTo(column,p)]" in plan or "In(column, [p])" in plan


def test_one_aggregate_gives_what_acceptance_leaves_alone(side):
    h = ["id", "p", "q", "r"]
    d = Diff(side(h, *fields(5), ("x", "1", "1", "1")), side(h, *fields(6), ("y", "1", "1", "1")), ["id"])
    found = {r.column: r for r in roster.reading(d).collect()}
    equal = {r.column: r.equal for r in summary.equal_counts(d).collect()}
    const = {r.column: (r.const_a, r.const_b) for r in summary.column_constants(d).collect()}
    assert {c: r.equal for c, r in found.items()} == equal and {c: (r.const_a, r.const_b) for c, r in found.items()} == const
    assert {(r.matched, r.a_only, r.b_only) for r in found.values()} == {(60, 1, 1)}
    bare = Diff(side(["id"], ("1",)), side(["id"], ("1",)), ["id"])
    assert roster.reading(bare).first().matched == 1
    rows = lambda x: sorted(map(repr, x.collect()))
    assert rows(roster.column_reading(d)) == rows(roster.reading(d).drop("matched", "a_only", "b_only"))
    assert "FullOuter" not in roster.column_reading(d)._jdf.queryExecution().executedPlan().toString()


def test_cells_are_counted_where_they_are_made(side):
    h = ["id", "p", "q", "r"]
    d = Diff(side(h, *fields(1)), side(h, *fields(2)), ["id"])
    store = d.mismatches.where("column <> 'q' and k0 % 3 = 0").unionByName(d.mismatches.where("column = 'r'"))  # some twice
    store = store.unionByName(store.limit(5).withColumn("val_a", F.lit("other")))
    rows = lambda x: sorted(map(repr, x.collect()))
    found = roster.counted_cells(d, store)
    assert rows(found) == rows(roster.counted(d.mismatches, store, snapshots.cell_identity(d))) and found.count()
    # before cells are stacked, nothing but keys decides where a row goes
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all("column" not in line for line in plan.splitlines() if "Join" in line)


# ---- ordered pages


def test_ordered_pages(spark):
    r = random.Random(8)
    rows = [(str(r.randrange(90)), r.randrange(5), i) for i in range(437)]
    held = pages.Ordered(spark.createDataFrame(rows, "a string, n long, i long").repartition(5), [("n", False), ("a", True), ("i", True)])
    want = sorted(rows, key=lambda x: (-x[1], x[0], x[2]))
    assert held.n == 437 and held.pages() == 5 and held.pages(10) == 44
    for size, numbers in ((100, range(5)), (7, (0, 31, 62))):
        for k in numbers:
            assert [tuple(x) for x in held.page_frame(k, size).collect()] == want[k * size : (k + 1) * size]
    assert held.page(99)[1:] == (4, 5) and held.page_frame(9).count() == 0
    for at in (0, 100, 436):
        a, n, i = want[at]
        assert held.page_of({"a": a, "n": n, "i": i}) == divmod(at, 100)
        assert tuple(held.beside({"i": i})) == want[at + 1 if at < 436 else at - 1]
    assert held.page_of({"i": -1}) is None and held.beside({"i": -1}) is None
    assert sorted((x.place, x.i) for x in held.placed(F.col("n") == 4).collect()) == [(k, x[2]) for k, x in enumerate(want) if x[1] == 4]
    empty = pages.Ordered(spark.createDataFrame([], "a string"), [("a", True)])
    assert empty.page(3) == ([], 0, 1) and empty.page_of({"a": "x"}) is None
    with pytest.raises(ValueError):
        held.page_frame(0, 101)
    assert "PushedFilters: [" in (plan := held.page_frame(4)._jdf.queryExecution().executedPlan().toString()) and "at__" in plan.split("PushedFilters: ")[1]


def test_context_narrows_both_sides_below_the_join(side):
    h = ["id", "val", "w"]
    d = Diff(side([*h, "x"], *((str(i), "a", f"w{i}", "e") for i in range(300))), side(h, *((str(i), "b", f"v{i}") for i in range(5, 305))), ["id"])
    page = pages.page_frame(d.mismatches.where("column = 'val'"), d.k, 1)
    found = pages.with_context(d, page, ["w", "x"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    got = sorted(tuple(r) for r in found.collect())
    keys = sorted(str(i) for i in range(5, 300))[100:200]
    assert got == [(k, "val", "a", "b", f"w{k}", "e", f"v{k}", None) for k in keys]
    assert plan.count("LeftSemi") == 2 and "FullOuter" not in plan and "SortMergeJoin" not in plan


def test_neighbours_of_a_pair(spark):
    rows = [("a", "b", 5), ("a", "c", 5), ("z", "a", 9), ("q", "q", 1)]
    pairs = spark.createDataFrame(rows, "val_a string, val_b string, n long")
    order = [("z", "a"), ("a", "b"), ("a", "c"), ("q", "q")]
    for i, pair in enumerate(order):
        (found,) = pages.neighbours(pairs, *pair).collect()
        name = lambda x: x and (x.val_a, x.val_b)
        assert name(found.next) == (order[i + 1] if i < 3 else None) and name(found.previous) == (order[i - 1] if i else None)
        assert name(found.first) == order[0] and name(found.last) == order[-1]
        beside = pages.pair_beside(pairs, *pair).first()
        assert (beside.val_a, beside.val_b) == (order[i + 1] if i < 3 else order[2])
    assert pages.pair_beside(pairs, "no", "pair").count() == 0 and pages.pair_beside(pairs.where("n = 9"), "z", "a").count() == 0


# ---- folders of text


def text_of(rows, r):
    out = io.StringIO()
    csv.writer(out, lineterminator=r.choice(["\n", "\r\n"])).writerows(rows)
    return out.getvalue()


def test_folders_are_read_in_ranges(spark, tmp_path):
    r = random.Random(12)
    for trial, size in enumerate((40, 150, 4000)):
        want = []
        at = tmp_path / f"t{trial}"
        at.mkdir()
        for f in range(3):
            value = lambda: "".join(r.choice(['"', ",", "\n", "\r\n", "a", "é", " ", "x" * 9]) for _ in range(r.randrange(12)))
            rows = [(f"{f}-{i}", value(), value() if i % 9 else "\n".join("long" * 5 for _ in range(12))) for i in range(40)]
            want += [x for x in rows]
            (at / f"part-{f}.csv").write_bytes(("﻿" * (f == 1) + text_of([("id", "v", "v"), *rows], r)).encode())
        headers, frame = lines.read(spark, str(at), "utf8", ",", size)
        assert headers == ["id", "v", "v_duplicated_0"] and sorted(map(tuple, frame.collect())) == sorted(want)
    side = source(str(tmp_path / "t0"), "A", delimiter=",").load(spark)
    assert side.frame.count() == 120
    remote = source(f"file://{tmp_path}/t1", "A", delimiter=",")
    assert remote.path.startswith("file:") and remote.load(spark).headers == ("id", "v", "v_duplicated_0")


def test_small_ranges_make_few_tasks(spark, tmp_path, monkeypatch):
    want = [(str(i), 'a"\nb' if i % 7 == 0 else "x" * (i % 50)) for i in range(4000)]
    for f in range(2):
        (tmp_path / f"part-{f}.csv").write_text(text_of([("id", "v"), *want[f::2]], random.Random(f)))
    made = []
    monkeypatch.setattr(lines, "_lines", lambda *x, found=lines._lines: made.append(found(*x)) or made[-1])
    monkeypatch.setattr(lines, "_ROWS", 100)
    headers, frame = lines.read(spark, str(tmp_path), "utf8", ",", 500)
    assert sorted(map(tuple, frame.collect())) == sorted((a, b) for a, b in want)
    assert made[0].select("file", "start").distinct().count() > 200  # ranges stay as small as they are wanted
    assert made[0].rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("texts", [["id,v\n1,a\n", "id,w\n1,a\n"], ["id,v\n1,a,b\n"], ['id,v\n1,"a\n2,b\n'], ["id,v\n1,\xff\n"], ['id,v\n1,"a"b\n'], [""]])
def test_folders_are_read_strictly(spark, tmp_path, texts):
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.csv").write_bytes(t.encode("latin-1"))
    for size in (8, 1 << 20):
        with pytest.raises(HardFail):
            try:
                lines.read(spark, str(tmp_path), "utf8", ",", size)[1].collect()
            except HardFail:
                raise
            except Exception as e:
                raise HardFail(str(e)) from e
    with pytest.raises(HardFail):
        source(str(tmp_path), "A", delimiter=",").load(spark)


# ---- texts


def test_visible_texts_and_windows(spark):
    rows = [("", ""), ("  ", "··"), (" a b ", "·a b·"), ("a\tb\n", "a→b↵"), ("x y z\r", "x␣y␣z␍"), ("é😀", "é😀")]
    frame = spark.createDataFrame(rows, "x string, want string")
    for r in frame.select("x", "want", visible(F.col("x")).alias("got")).collect():
        assert r.got == (r.want or "(empty)")
    text = "".join(chr(97 + i % 26) for i in range(60))
    for at in range(61):
        (got,) = spark.range(1).select(window(F.lit(text), F.lit(at), 12)).first()
        assert len(got) == 12 and (at >= 60 or text[at] in got)
        assert (got[0] != "…" and got[-1] == "…") if at < 11 else got[0] == "…"
        if at in (20, 59, 60):
            assert got.strip("…") in text
    a, b = spark.createDataFrame([("x" * 50 + "1", "x" * 50 + "2")], "a string, b string").select(*pair_text(F.col("a"), F.col("b"))).first()
    assert a.endswith("1") and b.endswith("2") and len(a) == len(b) == 32
    assert spark.range(1).select(*pair_text(F.lit(""), F.lit("0"))).first() == ("(empty)", "0")


def test_texts_of_constants_and_top_values():
    assert [constant_text(*x) for x in ((None, None), ("", None), (None, "a b"), ("x", 'q"'), ("5", "5"))] == ["", 'A=""', 'B="a b"', 'A=x B="q\\""', "A=5 B=5"]
    assert top_text([]) == "" and top_text(["b", "a", "", "a"]) == "a×2 | (empty)×1 | b×1"
    assert top_text("abcdefg") == "a×1 | b×1 | c×1 | d×1 | e×1 | +2 more"


def test_line_breaks_at_the_end_are_no_part_of_a_date_or_number(spark):
    rows = [("2020-01-01\n", "20200101", "date"), ("1234\n", "2034-12-01", "date"), ("012\n", "12\n", "idpad"), ("012\n", "12\n", "xlsdate"), ("44927\n", "2023-01-01", "xlsdate"), ("1%\n\n5", "1%5", "pct")]
    for a, b, name in rows:
        assert not checked(spark.createDataFrame([(a, b)], "val_a string, val_b string"), names=[name]).first()[f"check_{name}"]
    for a, b, name in (("7", "7\n", "num"), ("50%\n", "0.5", "pct"), ("(5)\n", "-5", "acctneg"), ("a \n", "a", "trim")):
        assert checked(spark.createDataFrame([(a, b)], "val_a string, val_b string"), names=[name]).first()[f"check_{name}"]


# ---- the session

H = ["id", "qty", "amt", "note", "gone"]
A = [("1", "", "", "a", "g"), ("2", "", "", "B", "g"), ("3", "5", "x", "c", "g"), ("4", "", "x", "c", "h"), ("8", "k", "k", "k", "k"), ("85", "k", "k", "k", "k")]
B = [("1", "0", "0", "a "), ("2", "0", "0", "b"), ("3", "5", "y", "c"), ("4", "0", "z", "c"), ("9", "m", "m", "m")]


@pytest.fixture
def data():
    return {"a": list(A), "b": list(B)}


@pytest.fixture
def session(side, data):
    return Session(lambda: (side(H, *data["a"]), side(H[:4], *data["b"])), ["id"])


def test_accepts_and_undos_leave_the_counts_of_a_new_session(session, side, data):
    session.accept_pair("amt", "", "0")
    session.accept_cell(("1",), "qty")
    session.accept_unmatched("A", ("8",))
    session.accept_extra("gone", "A")
    assert session.by_column == {"qty": 2, "amt": 2, "note": 2} and session.accepted_by_column == {"qty": 1, "amt": 2}
    rows = {r["name"]: r for r in session.roster()}
    other = Session(session.load, ["id"])
    other.accepted_cells, other.accepted_rows_store, other.extras = session.accepted_cells, session.accepted_rows_store, set(session.extras)
    other._read()
    assert {r["name"]: r for r in other.roster()} == rows and other.overview() == session.overview()
    assert session.undo_cell(("1",), "qty") == 1 and session.by_column["qty"] == 3 and session.undo_cell(("1",), "qty") == 0
    assert session.undo_unmatched("A", ("8",)) == 1 and session.pending_unmatched == {"A": 2, "B": 1}
    assert session.undo_extra("gone", "A") == 1 and session.undo_extra("gone", "A") == 0
    assert session.undo_logged(0) == 2 and session.accepted_by_column == {}
    with pytest.raises(ActionError):
        session.undo_logged(0)
    with pytest.raises(ActionError):
        session.undo()


def test_only_changed_columns_are_summed_up_again(session):
    session.roster()
    kept = session.kinds["note"], session.totals["note"]
    session.accept_pair("amt", "", "0")
    assert "amt" not in session.kinds and session.kinds["note"] is kept[0] and session.totals["note"] is kept[1]
    suggested = session.suggestions()
    assert session.suggestions() is suggested


def test_the_list_goes_on_below_what_was_accepted(session):
    session.drill("amt")
    session.select_pair("x", "y")
    assert session.accept() == 1
    assert session.place.screen == "pairs" and session.place.pair == ("x", "z") and session.place.focus == 1
    assert session.accept() == 1 and session.place.pair == ("", "0")
    session.go("unmatched_a")
    session.accept(("8",))
    assert session.place.screen == "unmatched_a" and (session.place.page, session.place.focus) == (0, 1)
    assert session.place_of_last_pair() is None
    session.undo_pair("amt", "x", "z")
    assert session.place_of_last_pair() == Place("pairs", "amt", ("x", "z"), 0, 1)


def test_context_stands_beside_pairs_and_cells(session):
    with pytest.raises(ActionError):
        session.toggle_context("note")
    session.drill("qty")
    for name, group in (("note", None), ("gone", 3), ("amt", 3)):
        session.toggle_context(name, group)
    for bad in (("qty", None), ("nope", None), ("note", 10)):
        with pytest.raises(ActionError):
            session.toggle_context(*bad)
    assert [v.header for v in session.views("qty")] == ["note", "3: amt + gone"]
    (row,) = session.page()[0]
    assert (row.val_a, row.val_b, row.n) == ("", "0", 3)
    assert row.view0__ == "B×1 | a×1 | a ×1 | b×1 | c×1" and row.view1__ == "(empty)|g×2 | x|h×1"
    session.drill()
    rows = session.page()[0]
    assert [(r.k0, r.view0_a__, r.view0_b__, r.view1_a__, r.view1_b__) for r in rows] == [("1", "a", "a ", "(empty)|g", "0|(empty)"), ("2", "B", "b", "(empty)|g", "0|(empty)"), ("4", "c", "c", "x|h", "z|(empty)")]
    session.toggle_context("note")
    session.toggle_context("gone", 3)
    assert [v.header for v in session.views("qty")] == ["3: amt"]


def test_a_refresh_leaves_new_keys_of_a_draft_unchecked(session, data):
    session.drill("qty")
    session.drill()
    session.toggle(("1",))
    session.toggle(("2",))
    data["a"].append(("5", "", "x", "c", "g"))
    data["b"] = [x for x in B if x[0] != "1"] + [("5", "0", "x", "c")]
    delta = session.refresh()
    assert delta.mismatched_columns == (1, 1) and session.place.screen == "cells" and session.draft.of_pair
    assert sorted(r.k0 for r in session.draft.unchecked.current().collect()) == ["2", "5"]  # 5 is new, 1 is gone
    assert session.confirm() == 1 and session.accepted.first().k0 == "4"


def test_marks_stay_with_the_pages(session, data):
    session.accept_column("qty")
    session.accept_unmatched("A", ("8",))
    data["b"][0] = ("1", "7", "0", "a ")
    data["a"][4] = ("8", "k", "k", "k", "changed")
    delta = session.refresh()
    assert delta.returned == 2 and delta.returned_names == ("qty",) and delta.message().endswith("2 returned qty")
    session.drill("qty")
    assert [(r.val_b, r.returned) for r in session.page()[0]] == [("7", True)]
    session.drill()
    assert [(r.k0, r.returned) for r in session.page()[0]] == [("1", True)]
    session.back()
    session.back()
    session.go("unmatched_a")
    assert [(r.k0, r.accepted, r.returned) for r in session.page()[0]] == [("8", False, True), ("85", False, False)]
    session.accept(("8",))
    assert [(r.k0, r.accepted, r.returned) for r in session.page()[0]] == [("8", True, False), ("85", False, False)]
    session.accept_column("qty")
    assert session.returned_columns() == []


def test_a_grain_that_covers_nothing_any_more_is_forgotten(session, data):
    session.accept_cell(("1",), "qty")
    data["b"][0] = ("1", "7", "0", "a ")
    session.refresh()
    assert session.log == []
    with pytest.raises(ActionError):
        session.undo()
    assert session.undo_column("qty") == 1 and session.by_column["qty"] == 3


def test_a_pair_is_picked_from_the_list_over_columns(session):
    rows, page, count = session.same_pairs()
    assert (page, count) == (0, 1) and [(r.val_a, r.val_b, r.n, r.n_cols) for r in rows][0] == ("", "0", 5, 2)
    with pytest.raises(ActionError):
        session.accept_same(0, len(rows))
    session.draft_by_name("amt")
    assert [(r.n, r.n_cols) for r in session.same_pairs()[0]] == [(2, 1), (1, 1), (1, 1)]
    assert session.accept_same(0, 0) == 2 and session.by_column["qty"] == 3 and session.draft.columns == ["amt"]
    session.back()
    assert session.same_pairs()[0][0].n == 3
    session.drill("qty")
    with pytest.raises(ActionError):
        session.accept_same(0, 0)


def test_identity_lines_name_sheet_and_keys(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text("id,v\n1,x\n")
    s = Session.of_sources(spark, source(str(tmp_path / "a.csv"), "A"), source(str(tmp_path / "b.csv"), "B"), ["id"])
    assert s.identity_lines() == [f"A: {tmp_path}/a.csv (utf8, comma)", f"B: {tmp_path}/b.csv (utf8, comma)", "keys: id"]


def test_the_next_sheet_begins_clean_or_not_at_all(side):
    def open_sheet(name):
        def load():
            if name == "bad":
                raise HardFail("no such sheet")
            return side(["id", "v"], ("1", "a"), ("2", name)), side(["id", "v"], ("1", "b"), ("2", "b"))

        return load

    s = Session(open_sheet("one"), ["id"], ["one", "two", "bad"], open_sheet)
    s.accept_pair("v", "a", "b")
    with pytest.raises(ActionError):
        s.next_sheet()
    s.next_sheet(confirmed=True)
    assert s.sheet == 1 and s.by_column == {"v": 2} and s.cells is None and s.last_pair == ("v", ("a", "b"))
    assert s.place_of_last_pair() == Place("pairs", "v", ("a", "b"), 0, 0)
    with pytest.raises(HardFail):
        s.next_sheet(confirmed=True)
    assert s.sheet == 1 and s.by_column == {"v": 2} and s.accept_column("v") == 2
