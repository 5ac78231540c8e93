import pytest

from exactdiff import cli
from exactdiff.errors import ActionError, HardFail
from exactdiff.session import Place, Session

HEADERS = ["id", "qty", "amt", "note", "gone"]
A = [("1", "", "", "a", "g"), ("2", "", "", "B", "g"), ("3", "5", "x", "c", "g"), ("8", "k", "k", "k", "k")]
B = [("1", "0", "0", "a "), ("2", "0", "0", "b"), ("3", "5", "y", "c"), ("9", "m", "m", "m")]


@pytest.fixture
def data():
    return {"a": list(A), "b": list(B)}


@pytest.fixture
def session(side, data):
    def load():
        if data["b"] is None:
            raise HardFail("unreadable")
        return side(HEADERS, *data["a"]), side(HEADERS[:4], *data["b"])

    return Session(load, ["id"])


def test_counts_and_roster(session):
    assert session.by_column == {"qty": 2, "amt": 3, "note": 2} and session.pending_total() == 7 + 2 + 1 and session.remaining_work() == 3 + 2 + 1
    rows = session.roster()
    assert [r["name"] for r in rows] == ["qty", "amt", "note", "A", "B", "gone"]
    amt = rows[1]
    assert amt["top"] == ("", "0") and amt["top_text"] == "67%" and amt["const_a"] is None and amt["categorical"] == "yes" and amt["equal"] == 0
    assert session.overview()["pending_total"] == 10 and session.quit() == 1


def test_accept_walks_on_and_undo_is_whole(session):
    session.drill("amt")
    assert session.place == Place("pairs", "amt", ("", "0"))
    assert session.accept() == 2 and session.place == Place("pairs", "amt", ("x", "y"))
    assert session.accept() == 1 and session.place.column == "note"
    assert session.undo() == 1 and session.by_column["amt"] == 1
    with pytest.raises(ActionError):
        session.undo()
    assert session.undo_column("amt") == 2 and session.by_column["amt"] == 3


def test_pair_across_columns_is_one_unit(session):
    assert session.accept_pair_across("", "0") == 4 and "qty" not in session.by_column
    assert session.undo() == 4 and session.by_column["qty"] == 2


def test_column_drafts(session):
    session.draft_by_name("^(qty|amt)$")
    assert session.draft.columns == ["qty", "amt"]
    with pytest.raises(ActionError):
        session.draft_by_name("note")
    with pytest.raises(ActionError):
        session.drill("qty")
    session.toggle("amt")
    session.toggle("note")
    assert session.draft.columns == ["qty", "note"] and session.confirm() == 4 and session.place == Place()
    assert session.undo() == 4
    session.draft_by_check("trim+case")
    assert session.draft.columns == ["note"]
    session.back()
    session.draft_by_constant("B", "0") if "qty" in [] else None
    with pytest.raises(ActionError):
        session.draft_by_constant("A", "nothing")
    for bad in ("", "(", "zzz"):
        with pytest.raises(ActionError):
            session.draft_by_name(bad)


def test_pair_draft(session):
    session.drill("qty")
    session.drill()
    assert session.place.screen == "cells" and len(session.page()[0]) == 2
    session.toggle(("1",))
    session.toggle(("2",))
    with pytest.raises(ActionError, match="unchecked"):
        session.confirm()
    session.toggle(("2",))
    assert session.confirm() == 1 and session.by_column["qty"] == 1
    session.repeat()
    assert session.draft.of_pair
    with pytest.raises(ActionError):
        session.accept_column("amt")
    session.back()
    assert session.draft is None


def test_unmatched_and_extras(session):
    session.go("unmatched_a")
    assert session.accept(("8",)) == 1
    with pytest.raises(ActionError):
        session.accept(("8",))
    session.go("unmatched_b")
    session.accept_all()
    session.go("extras")
    assert session.accept(("gone", "A")) == 1 and not session.pending_extras()
    assert session.undo() == 1 and session.pending_extras() == [("gone", "A")]
    for c in ("qty", "amt", "note"):
        session.accept_column(c)
    session.accept_extra("gone", "A")
    assert session.pending_total() == 0 and session.quit() == 0 and session.next_lever() == Place()


def test_refresh(session, data):
    session.accept_column("qty")
    session.go("unmatched_b")
    session.accept_all()
    data["b"] = [("1", "7", "0", "a "), ("2", "0", "0", "b"), ("3", "5", "y", "c"), ("9", "m", "m", "changed")]
    delta = session.refresh()
    assert delta.returned == 2 and delta.message() == "pending columns 2→3 · unmatched keys 1→2 · mismatched columns 1→1 · 2 returned qty"
    assert [r["returned"] for r in session.roster()[:3]] == [True, False, False]
    data["b"] = list(B)
    session.refresh()
    assert "qty" not in session.by_column  # the old snapshot covers the old value again
    data["b"] = None
    with pytest.raises(HardFail):
        session.refresh()
    assert session.by_column == {"amt": 3, "note": 2}


def test_tabs_pages_and_refusals(session):
    with pytest.raises(ActionError):
        session.tab(1)
    session.drill("qty")
    session.tab(1)
    session.tab(1)
    assert session.place.screen == "equal" and [r.val_a for r in session.page()[0]] == ["5"]
    session.tab(1)
    with pytest.raises(ActionError):
        session.tab(1)
    with pytest.raises(ActionError):
        session.turn(1)
    with pytest.raises(ActionError):
        session.accept()
    with pytest.raises(ActionError):
        session.next_sheet()


def test_command_line(spark, tmp_path, capsys):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("id,year,Status,Flag\n1,2020,Y,1\n2,2020,Y,1\n3,2021,N,0\n4,2021,N,x\n")
    b.write_text("id,year,Status,Flag\n1,2020,Yes,1\n2,2020,Yes,1\n3,2021,No,0\n5,2021,N,y\n")
    run = lambda *x: cli.main(list(x), spark)
    assert run("--a", str(a), "--b", str(b), "--keys", "id,year") == 1
    assert "Status: 3 pending, top pair 'Y' → 'Yes' 67% [bool]" in capsys.readouterr().out
    assert run("--a", str(a), "--b", str(a), "--keys", "id,year") == 0
    assert run("--a", str(a), "--b", str(b)) == 2 and run("--a", str(a), "--b", str(tmp_path / "no.csv"), "--keys", "id") == 2
    assert run("--a", str(a), "--b", str(b), "--keys", "year") == 2 and "side A has the key ('2020',) on 2 rows" in capsys.readouterr().err
