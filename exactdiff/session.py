"""A headless session: the job's state, the actions a user has, and what each refuses.

Differences stay in Spark. Python holds names, counts by column and at most a page of rows. What has been accepted is a
store of signed rows, and so are the counts of pairs: an accept or undo adds its own cells to both, and only the columns
that these cells belong to are summed up again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from exactdiff.errors import ActionError, HardFail
from exactdiff.functions.checks import CHECKS
from exactdiff.functions.text import constant_text
from exactdiff.lineage import cut
from exactdiff.operators import pages, roster, snapshots, suggest, summary
from exactdiff.operators.diff import Diff, Side
from exactdiff.operators.store import Store, signed
from exactdiff.sources.load import Source
from exactdiff.streaming import refresh

SCREENS = ("roster", "pairs", "accepted", "equal", "all_matched", "cells", "unmatched_a", "unmatched_b", "extras", "overview")
TABS = ("pairs", "accepted", "equal", "all_matched")
PAGED = ("pairs", "accepted", "equal", "all_matched", "cells", "unmatched_a", "unmatched_b")


@dataclass(frozen=True)
class Place:
    screen: str = "roster"
    column: str | None = None
    pair: tuple[str, str] | None = None
    page: int = 0
    focus: int = 0


@dataclass(frozen=True)
class Grain:
    """What an accepting action added; undo takes it away as one."""

    kind: str
    what: tuple
    cells: DataFrame | None = None
    rows: DataFrame | None = None
    n: int = 0

    def touches(self, column: str) -> bool:
        """Whether it accepted cells of a column."""
        if self.cells is None:
            return False
        at = {"cell": self.what[1:], "pairs": self.what[2:], "columns": self.what}.get(self.kind, self.what[:1])
        return column in at


@dataclass
class Draft:
    """Columns that a column draft holds; or a pair draft's column, pair and the keys that are unchecked."""

    columns: list[str] | None = None
    column: str | None = None
    pair: tuple[str, str] | None = None
    unchecked: Store | None = None

    @property
    def of_pair(self) -> bool:
        return self.pair is not None


@dataclass(frozen=True)
class View:
    """A context column, or a group of them, that is shown beside a column's pairs and cells."""

    header: str
    members: tuple[str, ...]
    group: int | None = None


@dataclass(frozen=True)
class Delta:
    """Counts before and after a refresh, and the columns that came and went. mismatched_columns are pending columns of
    one side only; returned_names the columns whose accepted cells have moved."""

    pending_columns: tuple[int, int]
    unmatched: tuple[int, int]
    mismatched_columns: tuple[int, int]
    returned: int
    added: tuple[str, ...]
    removed: tuple[str, ...]
    returned_names: tuple[str, ...] = ()

    def message(self) -> str:
        show = lambda name, x: f"{name} {x[0]}→{x[1]}"
        parts = [show("pending columns", self.pending_columns), show("unmatched keys", self.unmatched), show("mismatched columns", self.mismatched_columns)]
        return " · ".join([*parts, " ".join([f"{self.returned} returned", ", ".join(self.returned_names)]).strip()])


class Session:
    """load: gives both sides, at the start and at every refresh."""

    def __init__(self, load: Callable[[], tuple[Side, Side]], keys: Sequence[str], sheets: Sequence[str] = (), open_sheet: Callable[[str], Callable[[], tuple[Side, Side]]] | None = None) -> None:
        self.load, self.keys, self.sheets, self.open_sheet = load, list(keys), list(sheets), open_sheet
        self.sheet, self._sources = 0, ()
        self._clean()

    @classmethod
    def of_sources(cls, spark: SparkSession, a: Source, b: Source, keys: Sequence[str], sheets: Sequence[str] = ()) -> Session:
        reading = lambda name: lambda: (replace(a, sheet=name).load(spark), replace(b, sheet=name).load(spark))
        made = cls(reading(sheets[0]), keys, sheets, reading) if sheets else cls(lambda: (a.load(spark), b.load(spark)), keys)
        made._sources = (a, b)
        return made

    def _clean(self) -> None:
        self.accepted_cells: Store | None = None
        self.accepted_rows_store: Store | None = None
        self.extras: set[tuple[str, str]] = set()
        self.log: list[Grain] = []
        self.grain: Grain | None = None
        self.draft: Draft | None = None
        self.last_pair: tuple[str, tuple[str, str]] | None = None
        self.returned: DataFrame | None = None
        self.returned_rows: DataFrame | None = None
        self.context: dict[str, list[str]] = {}
        self.groups: dict[str, dict[int, list[str]]] = {}
        self.place = Place()
        self._read()

    def _read(self) -> None:
        found = Diff(*self.load(), self.keys)
        found.check_keys()
        found.joined = found.joined.cache()
        found.mismatches = found.mismatches.cache()
        self.diff = found
        self.unmatched = {s: snapshots.unmatched(found, s) for s in "AB"}
        rows = roster.reading(found).collect()  # a row for each column
        self.fixed = {r.column: r for r in rows}
        self.matched_count = rows[0].matched
        self.only_count = {"A": rows[0].a_only, "B": rows[0].b_only}
        self.counts = roster.new_counts(roster.counted(found.mismatches, self.cells, self.cell))
        self.totals: dict[str, Row] = {}
        self.kinds: dict[str, Row] = {}
        self.ordered: dict[tuple, pages.Ordered] = {}
        self._suggestions: list[suggest.Suggestion] | None = None
        self._count(None)
        self._count_rows()

    @property
    def cell(self) -> list[str]:
        """What names a cell's snapshot."""
        return snapshots.cell_identity(self.diff)

    @property
    def row(self) -> list[str]:
        return snapshots.unmatched_identity(self.diff)

    @property
    def cells(self) -> DataFrame | None:
        """The snapshots of cells, or None if there never was one."""
        return None if self.accepted_cells is None else self.accepted_cells.current()

    @property
    def rows(self) -> DataFrame | None:
        return None if self.accepted_rows_store is None else self.accepted_rows_store.current()

    @property
    def pending(self) -> DataFrame:
        return snapshots.split(self.diff.mismatches, self.cells, self.cell)[0]

    @property
    def accepted(self) -> DataFrame:
        return snapshots.split(self.diff.mismatches, self.cells, self.cell)[1]

    def pending_rows(self, side: str) -> DataFrame:
        return snapshots.split(self.unmatched[side], self.rows, self.row)[0]

    def accepted_rows(self, side: str) -> DataFrame:
        return snapshots.split(self.unmatched[side], self.rows, self.row)[1]

    def pairs_of(self, column: str) -> DataFrame:
        """val_a, val_b, n of a column's pending pairs, read from the counts."""
        found = self.counts.current((F.col("column") == column))
        if found is None:
            return self.diff.mismatches.select("column", "val_a", "val_b", F.lit(0).cast("long").alias("n")).limit(0)
        return found.where("pending > 0").select("column", "val_a", "val_b", F.col("pending").alias("n"))

    def _count(self, columns: Iterable[str] | None) -> None:
        """Sums up some columns, or all, from the counts of their pairs, and forgets what is known of their kinds."""
        columns = None if columns is None else list(columns)
        if columns == []:
            return
        frame = roster.totals(self.counts, columns)
        found = {} if frame is None else {r.column: r for r in frame.collect()}  # a row for each column
        for c in self.diff.comparable if columns is None else columns:
            self.totals.pop(c, None)
            self.kinds.pop(c, None)
            if c in found:
                self.totals[c] = found[c]
        self.ordered = {k: x for k, x in self.ordered.items() if columns is not None and k[1] not in columns and k[0] != "union"}
        live = {c: self.totals[c] for c in self.diff.comparable if c in self.totals}
        self.by_column = {c: r.pending for c, r in live.items() if r.pending}
        self.first_pair = {c: (live[c].val_a, live[c].val_b) for c in self.by_column}
        self.first_count = {c: live[c].top_n for c in self.by_column}
        self.accepted_by_column = {c: r.accepted for c, r in live.items() if r.accepted}

    def _count_rows(self) -> None:
        """Pending and accepted unmatched rows of each side; the ordered pages of unmatched rows are made anew."""
        self.pending_unmatched = dict(self.only_count)
        self.accepted_unmatched = {"A": 0, "B": 0}
        if self.rows is not None:
            done = self.accepted_rows("A").unionByName(self.accepted_rows("B")).groupBy("side").count().collect()
            for s, n in done:
                self.accepted_unmatched[s], self.pending_unmatched[s] = n, self.only_count[s] - n
        self.ordered = {k: x for k, x in self.ordered.items() if k[0] not in ("unmatched_a", "unmatched_b")}

    # ---- what there is

    def pending_extras(self) -> list[tuple[str, str]]:
        return [x for x in self.diff.extra_columns() if (x[1], x[0]) not in self.extras]

    def pending_total(self) -> int:
        return sum(self.by_column.values()) + sum(self.pending_unmatched.values()) + len(self.pending_extras())

    def remaining_work(self) -> int:
        """Columns, unmatched rows and extra columns that wait."""
        return len(self.by_column) + sum(self.pending_unmatched.values()) + len(self.pending_extras())

    def overview(self) -> dict[str, int]:
        counts = {"matched": self.matched_count, "a_only": self.only_count["A"], "b_only": self.only_count["B"], "pending": sum(self.by_column.values()), "pending_columns": len(self.by_column), "accepted": sum(self.accepted_by_column.values()), "extras": len(self.diff.extra_columns())}
        return counts | {"pending_a_only": self.pending_unmatched["A"], "pending_b_only": self.pending_unmatched["B"], "pending_extras": len(self.pending_extras()), "pending_total": self.pending_total()}

    def _kinds(self) -> dict[str, Row]:
        """Whether columns are categorical, and their checks; only columns that have changed are looked at again."""
        missing = [c for c in self.by_column if c not in self.kinds]
        if missing:
            self.kinds |= {r.column: r for r in roster.kinds(self.counts, missing).collect()}  # a row for each column
        return self.kinds

    def roster(self) -> list[dict]:
        """A row for each comparable column in A's order, then unmatched keys of A and of B, then extra columns."""
        kinds = self._kinds()
        back = self.returned_columns()
        out: list[dict] = []
        for c in self.diff.comparable:
            n, done, fixed, kind = self.by_column.get(c, 0), self.accepted_by_column.get(c, 0), self.fixed[c], kinds.get(c)
            share = self.first_count[c] / n if n else 0.0
            out.append({"kind": "column", "name": c, "pending": n, "accepted": done, "equal": fixed.equal, "status": "pending" if n else "accepted" if done else "equal", "top": self.first_pair.get(c), "concentration": share, "top_text": f"{100 * share:.0f}%" if n else "—",
                        "const_a": fixed.const_a, "const_b": fixed.const_b, "constant": constant_text(fixed.const_a, fixed.const_b), "categorical": kind.categorical if kind else "—", "checks": {k: kind[k] if kind else "—" for k in CHECKS}, "returned": c in back})
        for s in "AB":
            if self.pending_unmatched[s] or self.accepted_unmatched[s]:
                out.append({"kind": "unmatched", "name": s, "pending": self.pending_unmatched[s]})
        waiting = set(self.pending_extras())
        return out + [{"kind": "extra", "name": n, "side": s, "pending": int((n, s) in waiting)} for n, s in self.diff.extra_columns()]

    def returned_columns(self) -> list[str]:
        """Columns with pending cells that were accepted with other values, in A's order."""
        if self.returned is None:
            return []
        back = {r.column for r in self.returned.select("column").distinct().collect()}
        return [c for c in self.diff.comparable if c in back]

    def visible_roster(self, text: str = "", settled: bool = False) -> list[dict]:
        """The roster's rows whose name holds the text; columns without pending cells only if asked for."""
        return [r for r in self.roster() if text.lower() in r["name"].lower() and (settled or r["pending"])]

    def visible_checks(self) -> list[str]:
        """Checks that hold for some column."""
        return [k for k in CHECKS if any(r[k] == "y" for c, r in self._kinds().items() if c in self.by_column)]

    def suggestions(self) -> list[suggest.Suggestion]:
        """Computed once for each reading; no acceptance changes them."""
        if self._suggestions is None:
            self._suggestions = suggest.suggest(self.diff)
        return self._suggestions

    def identity_lines(self) -> list[str]:
        """Where both sides come from, the sheet's place among those of the job, and the keys."""
        lines = [(replace(x, sheet=self.sheets[self.sheet]) if self.sheets else x).line() for x in self._sources]
        if self.sheets:
            lines.append(f"sheet {self.sheet + 1} of {len(self.sheets)}: {self.sheets[self.sheet]}")
        return [*lines, f"keys: {', '.join(self.keys)}"]

    def _frame(self, p: Place) -> tuple[DataFrame, list[tuple[str, bool]]]:
        """The rows of a place with their marks, and their order."""
        keys = [(k, True) for k in self.diff.k]
        marked = lambda cells: refresh.marked(cells, self.returned, [*self.diff.k, "column"])
        if p.screen == "pairs":
            pairs = self.pairs_of(p.column)
            back = None if self.returned is None else snapshots.of_column(self.returned, p.column).select("column", "val_a", "val_b").distinct()
            return refresh.marked(pairs, back, ["column", "val_a", "val_b"]), [("n", False), ("val_a", True), ("val_b", True)]
        if p.screen == "accepted":
            return snapshots.of_column(self.accepted, p.column), keys
        if p.screen in ("equal", "all_matched"):
            cells = self.diff.tall(self.diff.matched, [p.column])
            return cells.where("val_a = val_b") if p.screen == "equal" else cells, keys
        if p.screen == "cells":
            return marked(snapshots.of_pair(self.pending, *p.pair, [p.column])), keys
        if p.screen in ("unmatched_a", "unmatched_b"):
            side = p.screen[-1].upper()
            done = refresh.marked(self.unmatched[side], self.rows, self.row, "accepted")
            return refresh.marked(done, self.returned_rows, ["side", *self.diff.k]).drop("side"), keys
        raise ActionError(f"{p.screen} has no rows to page through")

    def _pages(self, p: Place) -> pages.Ordered:
        """The place's rows in order, sorted once until something in them changes."""
        key = (p.screen, p.column, p.pair if p.screen == "cells" else None)
        if key not in self.ordered:
            self.ordered[key] = pages.Ordered(*self._frame(p))
        return self.ordered[key]

    def page(self) -> tuple[list[Row], int, int]:
        """The rows of the current place with its context, the page's number and the number of pages."""
        held = self._pages(self.place)
        rows, number, count = held.page(self.place.page)
        views = self.views(self.place.column) if self.place.column else []
        if rows and views:
            rows = self._beside(held.page_frame(number), views).collect()
        return rows, number, count

    def _beside(self, rows: DataFrame, views: list[View]) -> DataFrame:
        """A page's rows with a column for each view: values of both sides beside cells, summaries beside pairs."""
        order = [F.col(c).asc() if up else F.col(c).desc() for c, up in self._pages(self.place).order]
        if self.place.screen == "pairs":
            found = self.pair_summaries(views, rows).groupBy("val_a", "val_b").agg(*(F.max(F.when(F.col("view") == v.header, F.col("summary"))).alias(f"view{i}__") for i, v in enumerate(views)))
            return rows.join(F.broadcast(found), ["val_a", "val_b"], "left").orderBy(*order)  # a page of pairs
        members = list(dict.fromkeys(m for v in views for m in v.members))
        out = pages.with_context(self.diff, rows, members)
        shown = lambda x, v: F.coalesce(F.col(x), F.lit("")) if v.group is None else summary.context_value(F.coalesce(F.col(x), F.lit("")))
        each = [F.concat_ws("|", *(shown(f"{s}{members.index(m)}__", v) for m in v.members)).alias(f"view{i}_{s}__") for i, v in enumerate(views) for s in "ab"]
        return out.select(*rows.columns, *each).orderBy(*order)

    def pair_summaries(self, views: Sequence[View], pairs: DataFrame | None = None) -> DataFrame:
        """view, column, val_a, val_b, summary for the current column's pairs, or some of them, all views in one pass."""
        return summary.context_views(self.diff, self.place.column, {v.header: v.members for v in views}, self.cells, pairs)

    # ---- context

    def views(self, column: str) -> list[View]:
        """What is shown beside a column: single context columns as chosen, then groups 0 to 9, members in their order."""
        pool = [c for c in self.diff.context if c != column]
        single = [View(c, (c,)) for c in self.context.get(column, []) if c in pool]
        groups = [(g, tuple(c for c in pool if c in some)) for g, some in sorted(self.groups.get(column, {}).items())]
        return single + [View(f"{g}: {' + '.join(some)}", some, g) for g, some in groups if some]

    def toggle_context(self, name: str, group: int | None = None) -> None:
        """What `c` does: puts a context column beside the current column's pairs and cells, alone or in a group from 0
        to 9, or takes it away again."""
        column = self.place.column
        if column is None:
            raise ActionError("context belongs to a column")
        if name not in self.diff.context or name == column:
            raise ActionError(f"{name!r} can't stand beside {column!r}")
        if group is not None and group not in range(10):
            raise ActionError("groups are numbered 0 to 9")
        some = self.context.setdefault(column, []) if group is None else self.groups.setdefault(column, {}).setdefault(group, [])
        if name in some:
            some.remove(name)
        else:
            some.append(name)

    # ---- places

    def next_lever(self) -> Place:
        """Where work goes on: the same column's first pair, the next pending column's, unmatched keys, extras, the roster."""
        here = self.place.column
        order = self.diff.comparable
        later = order[order.index(here) :] + order[: order.index(here)] if here in order else order
        for c in later:
            if c in self.by_column:
                return Place("pairs", c, self.first_pair[c])
        for s in "AB":
            if self.pending_unmatched[s]:
                return Place(f"unmatched_{s.lower()}")
        return Place("extras") if self.pending_extras() else Place()

    def place_of_last_pair(self) -> Place | None:
        """The pair that was accepted last, on its page, if it is pending again or still."""
        if self.last_pair is None or self.last_pair[0] not in self.by_column:
            return None
        column, pair = self.last_pair
        at = self._pages(Place("pairs", column)).page_of(dict(zip(("val_a", "val_b"), pair)))
        return None if at is None else Place("pairs", column, pair, *at)

    def page_of_key(self, key: tuple[str, ...]) -> tuple[int, int]:
        """The page of a key on the current screen, and its row there; the first row if it isn't there."""
        return self._pages(self.place).page_of(dict(zip(self.diff.k, key))) or (0, 0)

    def seek(self, key: tuple[str, ...]) -> None:
        """Goes to the page of a key."""
        page, focus = self.page_of_key(key)
        self.place = replace(self.place, page=page, focus=focus)

    def _pair_below(self, column: str, pair: tuple[str, str]) -> tuple[str, str] | None:
        """Where the pair list goes on once a pair is done: the pair below it, else the one above, from one aggregate."""
        found = pages.pair_beside(self.pairs_of(column), *pair).first()
        return None if found is None else (found.val_a, found.val_b)

    def drill(self, column: str | None = None) -> None:
        if self.draft and not self.draft.of_pair:
            raise ActionError("finish the column draft first")
        if self.place.screen == "roster":
            if column not in self.diff.comparable:
                raise ActionError(f"no comparable column {column!r}")
            screen = "pairs" if column in self.by_column else "accepted" if self.accepted_by_column.get(column) else "equal"
            self.place = Place(screen, column, self.first_pair.get(column))
        elif self.place.screen == "pairs":
            self.start_pair(self.place.column, self.place.pair)
        else:
            raise ActionError("nothing to open here")

    def back(self) -> None:
        if self.place.screen == "cells":
            self.draft = None
            self.place = Place("pairs", self.place.column, self.place.pair)
        else:
            if self.draft and not self.draft.of_pair:
                self.draft = None
            self.place = Place()

    def go(self, screen: str) -> None:
        if screen not in SCREENS or screen in ("cells", *TABS):
            raise ActionError(f"no way to {screen} from here")
        self.place = Place(screen)

    def tab(self, step: int) -> None:
        if self.place.screen not in TABS:
            raise ActionError("tabs belong to a column")
        at = TABS.index(self.place.screen) + step
        if not 0 <= at < len(TABS):
            raise ActionError("no further tab")
        self.place = replace(self.place, screen=TABS[at], page=0)

    def turn(self, step: int) -> None:
        if self.place.screen not in PAGED:
            raise ActionError("there are no pages here")
        if not 0 <= self.place.page + step < self._pages(self.place).pages():
            raise ActionError("no further page")
        self.place = replace(self.place, page=self.place.page + step)

    def select_pair(self, val_a: str, val_b: str) -> None:
        if self.place.screen != "pairs":
            raise ActionError("pairs are chosen in a column's pair list")
        self.place = replace(self.place, pair=(val_a, val_b))

    # ---- drafts

    def _idle(self) -> None:
        if self.draft:
            raise ActionError("a draft is open")

    def _column_draft(self, columns: list[str]) -> None:
        self._idle()
        if self.place.screen != "roster":
            raise ActionError("column drafts start on the roster")
        if not columns:
            raise ActionError("no pending column fits")
        self.draft = Draft(columns=columns)

    def draft_by_name(self, pattern: str) -> None:
        try:
            fits = re.compile(pattern) if pattern else None
        except re.error as e:
            raise ActionError(f"bad pattern: {e}") from e
        if fits is None:
            raise ActionError("an empty pattern fits nothing")
        self._column_draft([c for c in self.by_column if fits.search(c)])

    def draft_by_constant(self, side: str, value: str) -> None:
        self._column_draft([c for c in self.by_column if self.fixed[c][f"const_{side.lower()}"] == value])

    def draft_by_check(self, check: str) -> None:
        if check not in CHECKS:
            raise ActionError(f"no check {check!r}")
        kinds = self._kinds()
        self._column_draft([c for c in self.by_column if kinds[c][check] == "y"])

    def toggle(self, what: str | tuple[str, ...]) -> None:
        """A pending column in a column draft, or a row of a pair draft by its key."""
        if self.draft is None:
            raise ActionError("no draft is open")
        if self.draft.of_pair:
            key = self.diff.joined.sparkSession.createDataFrame([tuple(what)], ", ".join(f"{k} string" for k in self.diff.k))
            held = self.draft.unchecked or Store(tuple(self.diff.k), ("n",))
            there = held.current(reduce(Column.__and__, (F.col(k) == v for k, v in zip(self.diff.k, what))))
            self.draft.unchecked = held.plus(signed(key, self.diff.k, 1 if there is None or there.isEmpty() else -1))
            return
        if what not in self.by_column:
            raise ActionError(f"{what!r} has nothing pending")
        columns = self.draft.columns
        if what in columns:
            columns.remove(what)
        else:
            self.draft.columns = [c for c in self.by_column if c in (*columns, what)]
        if not self.draft.columns:
            self.draft = None

    def start_pair(self, column: str, pair: tuple[str, str] | None) -> None:
        self._idle()
        if pair is None or self.pairs_of(column).where((F.col("val_a") == pair[0]) & (F.col("val_b") == pair[1])).isEmpty():
            raise ActionError("no such pending pair")
        self.draft = Draft(column=column, pair=pair)
        self.place = Place("cells", column, pair)

    def _drafted(self) -> DataFrame:
        """The checked cells of the open pair draft."""
        d = self.draft
        some = snapshots.of_pair(self.pending, *d.pair, [d.column])
        unchecked = None if d.unchecked is None else d.unchecked.current()
        return some if unchecked is None else snapshots.minus(some, unchecked, self.diff)

    # ---- accepting

    def _remember(self, grain: Grain) -> None:
        self.grain = grain
        self.log.append(grain)

    def _moved(self, cells: DataFrame, accepting: bool) -> None:
        """Counts follow cells that have been accepted, or are pending again."""
        self.counts = roster.moved(self.counts, cells, accepting)
        if accepting and self.returned is not None:
            self.returned = cut(self.returned.join(cells.select(*self.cell), self.cell, "left_anti"))
        self._count([r.column for r in cells.select("column").distinct().collect()])  # names of columns

    def _accept_cells(self, kind: str, what: tuple, some: DataFrame) -> int:
        """Accepts some pending cells."""
        delta = cut(some.select(*self.cell).distinct())
        n = delta.count()
        if n:
            held = self.accepted_cells or Store(tuple(self.cell), ("n",))
            self.accepted_cells = held.plus(signed(delta, self.cell, 1))
            self._remember(Grain(kind, what, cells=delta, n=n))
            self._moved(delta, True)
        return n

    def accept_column(self, column: str) -> int:
        if self.draft and self.draft.of_pair:
            raise ActionError("finish the pair draft first")
        if not self.by_column.get(column):
            raise ActionError(f"{column!r} has nothing pending")
        return self._accept_cells("column", (column,), snapshots.of_column(self.pending, column))

    def accept_pair(self, column: str, val_a: str, val_b: str) -> int:
        self.last_pair = (column, (val_a, val_b))
        return self._accept_cells("pair", (column, val_a, val_b), snapshots.of_pair(self.pending, val_a, val_b, [column]))

    def accept_pair_across(self, val_a: str, val_b: str, columns: Sequence[str] | None = None) -> int:
        """The pair in the drafted columns if a column draft is open, else in all pending ones: one unit for undo."""
        if self.draft and self.draft.of_pair:
            raise ActionError("finish the pair draft first")
        columns = list(columns or (self.draft.columns if self.draft else self.by_column))
        return self._accept_cells("pairs", (val_a, val_b, *columns), snapshots.of_pair(self.pending, val_a, val_b, columns))

    def same_pairs(self, page: int = 0) -> tuple[list[Row], int, int]:
        """What `m` lists on the roster: pairs over the drafted columns, or over all pending ones, as val_a, val_b, n and
        n_cols, the most frequent first; the page's number and the number of pages."""
        columns = tuple(self.draft.columns if self.draft and self.draft.columns else self.by_column)
        key = ("union", None, columns)
        if key not in self.ordered:
            found = self.counts.current(F.col("column").isin(list(columns))) if columns else None
            if found is None:
                return [], 0, 1
            pairs = found.where("pending > 0").groupBy("val_a", "val_b").agg(F.sum("pending").alias("n"), F.count("*").alias("n_cols"))
            self.ordered[key] = pages.Ordered(pairs, [("n", False), ("val_a", True), ("val_b", True)])
        return self.ordered[key].page(page)

    def accept_same(self, page: int, row: int) -> int:
        """Accepts the pair that stands in a row of same_pairs() in all columns that the list is of."""
        if self.place.screen != "roster":
            raise ActionError("the list of pairs over columns belongs to the roster")
        rows = self.same_pairs(page)[0]
        if not 0 <= row < len(rows):
            raise ActionError("no such row")
        return self.accept_pair_across(rows[row].val_a, rows[row].val_b)

    def accept_cell(self, key: tuple[str, ...], column: str) -> int:
        at = snapshots.of_column(self.pending, column)
        for k, v in zip(self.diff.k, key):
            at = at.where(F.col(k) == v)
        return self._accept_cells("cell", (key, column), at)

    def _accept_rows(self, kind: str, what: tuple, some: DataFrame) -> int:
        """Accepts some pending unmatched rows."""
        delta = cut(some.select(*self.row).distinct())
        n = delta.count()
        if n:
            held = self.accepted_rows_store or Store(tuple(self.row), ("n",))
            self.accepted_rows_store = held.plus(signed(delta, self.row, 1))
            self._remember(Grain(kind, what, rows=delta, n=n))
            if self.returned_rows is not None:
                self.returned_rows = cut(self.returned_rows.join(delta, self.row, "left_anti"))
            self._count_rows()
        return n

    def accept_unmatched(self, side: str, key: tuple[str, ...]) -> int:
        some = self.pending_rows(side)
        for k, v in zip(self.diff.k, key):
            some = some.where(F.col(k) == v)
        n = self._accept_rows("unmatched", (side, key), some)
        if not n:
            raise ActionError("this key is accepted already or not there")
        return n

    def accept_all_unmatched(self, side: str) -> int:
        n = self._accept_rows("unmatched_all", (side,), self.pending_rows(side))
        self.place = self.next_lever()
        return n

    def accept_extra(self, name: str, side: str) -> int:
        if (name, side) not in self.pending_extras():
            raise ActionError("this column is accepted already or not there")
        self.extras.add((side, name))
        self._remember(Grain("extra", (side, name), n=1))
        return 1

    def accept(self, what=None) -> int:
        """What `a` does: it depends on the place."""
        p = self.place
        if p.screen == "roster":
            return self.accept_column(what)
        if p.screen == "pairs":
            pair = tuple(what or p.pair)
            below = self._pair_below(p.column, pair)
            n = self.accept_pair(p.column, *pair)
            # the list stays where it was, on the pair below the one that has gone
            self.place = replace(p, pair=below, **self._spot(p.column, below)) if below and p.column in self.by_column else self.next_lever()
            return n
        if p.screen == "cells":
            n = self.accept_cell(what, p.column)
            self._select_after(what, self._drafted)
            return n
        if p.screen in ("unmatched_a", "unmatched_b"):
            side = p.screen[-1].upper()
            n = self.accept_unmatched(side, what)
            self._select_after(what, lambda: self.pending_rows(side))
            return n
        if p.screen == "extras":
            return self.accept_extra(*what)
        raise ActionError(f"nothing to accept on {p.screen}")

    def _spot(self, column: str, pair: tuple[str, str]) -> dict[str, int]:
        at = self._pages(Place("pairs", column)).page_of(dict(zip(("val_a", "val_b"), pair))) or (0, 0)
        return {"page": at[0], "focus": at[1]}

    def _select_after(self, key: tuple[str, ...], pending: Callable[[], DataFrame]) -> None:
        """Goes to the next pending row behind an accepted key, else to the last one that is left."""
        found = pages.after(pending().select(*self.diff.k), self.diff.k, key).first()
        if found is not None:
            self.seek(tuple(found))

    def accept_all(self) -> int:
        """What `A` does: everything of the place, and on to what comes next."""
        p = self.place
        if p.screen in ("unmatched_a", "unmatched_b"):
            return self.accept_all_unmatched(p.screen[-1].upper())
        if p.screen not in ("pairs", "cells"):
            raise ActionError(f"nothing to accept at once on {p.screen}")
        self._idle()
        n = self.accept_column(p.column) if p.screen == "pairs" else self.accept_pair(p.column, *p.pair)
        self.place = self.next_lever()
        return n

    def confirm(self) -> int:
        """Accepts what the open draft holds; a pair draft without a checked row stays open."""
        d = self.draft
        if d is None:
            raise ActionError("no draft is open")
        if d.of_pair:
            some = self._drafted()
            if some.isEmpty():
                raise ActionError("every row is unchecked")
            n = self._accept_cells("pair", (d.column, *d.pair), some)
            self.last_pair, self.draft = (d.column, d.pair), None
            self.place = self.next_lever()
            return n
        if self.place.screen != "roster":
            raise ActionError("column drafts are confirmed on the roster")
        n = self._accept_cells("columns", tuple(d.columns), self.pending.where(F.col("column").isin(d.columns)))
        self.draft = None
        return n

    def repeat(self) -> None:
        """Opens the draft of the pair that was accepted last if the place is its column, else goes there; where the pair is
        no longer pending, work goes on at the next lever."""
        self._idle()
        if self.place.screen not in TABS or self.last_pair is None:
            raise ActionError("nothing to repeat here")
        column, pair = self.last_pair
        if column not in self.diff.comparable:
            raise ActionError(f"column {column!r} is gone")
        landed = self.place_of_last_pair()
        if landed is not None and column == self.place.column:
            self.start_pair(column, pair)
        else:
            self.place = landed or self.next_lever()

    # ---- undoing

    def _forget(self, cells: DataFrame | None = None, rows: DataFrame | None = None) -> int:
        """Takes snapshots out of the stores; how many. Only those whose difference is still there change any count."""
        n = 0
        if cells is not None and self.accepted_cells is not None:
            gone = cut(self.cells.join(cells.select(*self.cell).distinct(), self.cell, "left_semi").select(*self.cell))
            n += gone.count()
            live = cut(self.diff.mismatches.join(gone, self.cell, "left_semi"))
            self.accepted_cells = self.accepted_cells.plus(signed(gone, self.cell, -1))
            self._moved(live, False)
        if rows is not None and self.accepted_rows_store is not None:
            gone = cut(self.rows.join(rows.select(*self.row).distinct(), self.row, "left_semi").select(*self.row))
            n += gone.count()
            self.accepted_rows_store = self.accepted_rows_store.plus(signed(gone, self.row, -1))
            self._count_rows()
        return n

    def still_applies(self, grain: Grain) -> bool:
        """Whether some of what an action accepted still covers a difference."""
        if grain.kind == "extra":
            return grain.what in self.extras and (grain.what[1], grain.what[0]) in self.diff.extra_columns()
        if grain.cells is not None:
            return self.cells is not None and not self.accepted.join(grain.cells.select(*self.cell), self.cell, "left_semi").isEmpty()
        if self.rows is None:
            return False
        rows = self.accepted_rows("A").unionByName(self.accepted_rows("B"))
        return not rows.join(grain.rows.select(*self.row), self.row, "left_semi").isEmpty()

    def _undo(self, grain: Grain) -> int:
        if grain in self.log:
            self.log.remove(grain)
        if grain.kind == "extra":
            return self.undo_extra(grain.what[1], grain.what[0])
        return self._forget(grain.cells, grain.rows)

    def undo(self) -> int:
        """Takes back the last accepting action as a whole, once."""
        g, self.grain = self.grain, None
        if g is None or not self.still_applies(g):
            raise ActionError("nothing to undo")
        return self._undo(g)

    def undo_logged(self, at: int) -> int:
        """Takes back any action of the log, by its place, if it still applies."""
        if not -len(self.log) <= at < len(self.log) or not self.still_applies(self.log[at]):
            raise ActionError("nothing to undo")
        grain = self.log[at]
        self.grain = None if grain is self.grain else self.grain
        return self._undo(grain)

    def _undo_cells(self, column: str, where: Column) -> int:
        if self.cells is None:
            return 0
        if self.grain and self.grain.touches(column):
            self.grain = None
        return self._forget(self.accepted_cells.current((F.col("column") == column) & where))

    def undo_column(self, column: str) -> int:
        return self._undo_cells(column, F.lit(True))

    def undo_pair(self, column: str, val_a: str, val_b: str) -> int:
        return self._undo_cells(column, (F.col("val_a") == val_a) & (F.col("val_b") == val_b))

    def _keyed(self, key: tuple[str, ...]) -> Column:
        return reduce(Column.__and__, (F.col(k) == v for k, v in zip(self.diff.k, key)))

    def undo_cell(self, key: tuple[str, ...], column: str) -> int:
        return self._undo_cells(column, self._keyed(key))

    def undo_unmatched(self, side: str, key: tuple[str, ...] | None = None) -> int:
        """The accepted rows of a side, or that of one key."""
        if self.rows is None:
            return 0
        if self.grain and self.grain.rows is not None and self.grain.what[0] == side:
            self.grain = None
        return self._forget(rows=self.accepted_rows_store.current((F.col("side") == side) & (F.lit(True) if key is None else self._keyed(key))))

    def undo_extra(self, name: str, side: str) -> int:
        if (side, name) not in self.extras:
            return 0
        self.extras.remove((side, name))
        if self.grain and self.grain.kind == "extra" and self.grain.what == (side, name):
            self.grain = None
        return 1

    # ---- reading again

    def refresh(self) -> Delta:
        """Both sides as they are now; if they can't be read, everything stays as it was and the failure is raised."""
        state = dict(self.__dict__)
        count = lambda: (len(self.by_column), sum(self.pending_unmatched.values()), len(self.pending_extras()))
        before, headers = count(), list(self.diff.comparable)
        kept_keys = len(self.diff.k)
        drafted = self.draft and self.draft.of_pair and snapshots.of_pair(self.pending, *self.draft.pair, [self.draft.column])
        try:
            self._read()
            if len(self.diff.k) != kept_keys:
                raise HardFail("the keys have changed")
            if drafted:
                d = self.draft
                now = snapshots.of_pair(self.pending, *d.pair, [d.column])
                unchecked = None if d.unchecked is None else d.unchecked.current()
                left = refresh.unchecked_after(drafted, now, unchecked, self.diff.k)
                self.draft = replace(d, unchecked=Store(tuple(self.diff.k), ("n",)).plus(signed(left, self.diff.k, 1)))
        except Exception:
            if self.diff is not state["diff"]:
                self.diff.joined.unpersist()
                self.diff.mismatches.unpersist()
            self.__dict__.update(state)
            raise
        state["diff"].joined.unpersist()
        state["diff"].mismatches.unpersist()
        # marks are derived once and go along with the pages from now on
        self.returned = None if self.cells is None else cut(refresh.returned_cells(self.diff, self.pending, self.cells))
        back = 0 if self.returned is None else self.returned.count()
        self.returned_rows = None if self.rows is None else cut(refresh.returned_keys(self.diff, self.pending_rows("A").unionByName(self.pending_rows("B")), self.rows))
        back += 0 if self.returned_rows is None else self.returned_rows.count()
        self.log = [g for g in self.log if self.still_applies(g)]
        self.grain = self.grain if self.grain in self.log else None
        self._prune()
        now = count()
        names = self.diff.comparable
        return Delta((before[0], now[0]), (before[1], now[1]), (before[2], now[2]), back, tuple(c for c in names if c not in headers), tuple(c for c in headers if c not in names), tuple(self.returned_columns()))

    def _prune(self) -> None:
        """Drafts and places whose column, pair or rows are gone; what is still there stays open where it was."""
        if self.draft and not self.draft.of_pair:
            self.draft.columns = [c for c in self.draft.columns if c in self.by_column]
            self.draft = self.draft if self.draft.columns else None
        elif self.draft and (self.draft.column not in self.by_column or self.pairs_of(self.draft.column).where((F.col("val_a") == self.draft.pair[0]) & (F.col("val_b") == self.draft.pair[1])).isEmpty()):
            self.draft = None
        p = self.place
        if p.column and p.column not in self.diff.comparable:
            self.place = self.next_lever()
        elif p.screen == "cells" and self.draft is None:
            self.place = Place("pairs", p.column, self.first_pair[p.column]) if p.column in self.by_column else self.next_lever()
        elif p.screen in ("unmatched_a", "unmatched_b") and not self.only_count[p.screen[-1].upper()] or p.screen == "extras" and not self.diff.extra_columns():
            self.place = Place()

    def next_sheet(self, confirmed: bool = False) -> None:
        """The next sheet of the job with a clean slate; only the last exact pair comes along. If the sheet can't be read,
        the session stays on the one before."""
        self._idle()
        if self.sheet + 1 >= len(self.sheets):
            raise ActionError("this is the last sheet")
        if self.remaining_work() and not confirmed:
            raise ActionError("work remains on this sheet; confirm to go on")
        state = dict(self.__dict__)
        try:
            self.sheet += 1
            self.load = self.open_sheet(self.sheets[self.sheet])
            self._clean()
        except Exception:
            self.__dict__.update(state)
            raise
        state["diff"].joined.unpersist()
        state["diff"].mismatches.unpersist()
        self.last_pair = state["last_pair"]

    def quit(self) -> int:
        """The exit code: 0 if nothing is pending, else 1. Drafts are discarded."""
        self.draft = None
        return int(self.pending_total() > 0)
