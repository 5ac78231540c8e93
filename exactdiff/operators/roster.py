"""What the roster shows of each column, and how it follows an accept or undo without looking at all cells again.

The pairs of values that stand in a column are kept with how many of their cells are pending and how many accepted: a
`Store` of signed counts. A change adds its own cells' counts to it, and only the columns that it touches are summed up
anew, from their pairs. What no acceptance changes (equal cells, constants, key counts) is taken from one aggregate of
the joined rows at each reading.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exactdiff.operators import snapshots, summary
from exactdiff.operators.diff import Diff
from exactdiff.operators.store import Store

PAIR = ("column", "val_a", "val_b")
COUNTS = ("pending", "accepted")


def counted(mismatches: DataFrame, accepted: DataFrame | None, identity: Sequence[str]) -> DataFrame:
    """column, val_a, val_b, pending, accepted: all pairs with the counts of their cells, in one pass."""
    if accepted is None:
        return mismatches.groupBy(*PAIR).agg(F.count("*").alias("pending"), F.lit(0).cast("long").alias("accepted"))
    known = accepted.select(*identity).distinct().withColumn("known", F.lit(True))
    marked = mismatches.join(known, list(identity), "left")
    return marked.groupBy(*PAIR).agg(F.count_if(F.col("known").isNull()).alias("pending"), F.count_if(F.col("known").isNotNull()).alias("accepted"))


def counted_cells(diff: Diff, accepted: DataFrame) -> DataFrame:
    """counted() of all unequal cells of diff, which are counted where they are made."""
    marked = snapshots.marked_cells(diff, accepted)
    return marked.groupBy(*PAIR).agg(F.count_if(~F.col("known__")).alias("pending"), F.count_if("known__").alias("accepted"))


def new_counts(pairs: DataFrame) -> Store:
    return Store(PAIR, COUNTS).plus(pairs)


def moved(counts: Store, cells: DataFrame, accepting: bool) -> Store:
    """The counts after some cells went from pending to accepted, or back."""
    n = cells.groupBy(*PAIR).agg(F.count("*").alias("n"))
    sign = 1 if accepting else -1
    return counts.plus(n.select(*PAIR, (F.col("n") * -sign).alias("pending"), (F.col("n") * sign).alias("accepted")))


def _of(counts: Store, columns: Collection[str] | None) -> DataFrame | None:
    return counts.current(None if columns is None else F.col("column").isin(list(columns)))


def totals(counts: Store, columns: Collection[str] | None = None) -> DataFrame | None:
    """column, pending, accepted, val_a, val_b, top_n: sums and the first pending pair, of some columns or all."""
    pairs = _of(counts, columns)
    return None if pairs is None else _totals(pairs)


def _totals(pairs: DataFrame) -> DataFrame:
    first = F.min(F.when(F.col("pending") > 0, F.struct((-F.col("pending")).alias("n"), "val_a", "val_b")))
    found = pairs.groupBy("column").agg(F.sum("pending").alias("pending"), F.sum("accepted").alias("accepted"), first.alias("x"))
    return found.select("column", "pending", "accepted", "x.val_a", "x.val_b", (-F.col("x.n")).alias("top_n"))


def _pending(pairs: DataFrame) -> DataFrame:
    return pairs.where("pending > 0").select(*PAIR, F.col("pending").alias("n"))


def kinds(counts: Store, columns: Collection[str] | None = None) -> DataFrame | None:
    """column, categorical and the checks, of columns with pending cells."""
    pairs = _of(counts, columns)
    return None if pairs is None else _kinds(_pending(pairs))


def _kinds(pending: DataFrame) -> DataFrame:
    return summary.categorical(pending).select("column", "categorical").join(summary.check_matrix(pending), "column")


def facts(pairs: DataFrame) -> DataFrame:
    """totals() and kinds() of a frame of counted() pairs: a row for each column that has any."""
    return _totals(pairs).join(_kinds(_pending(pairs)), "column", "left")


def after(before: DataFrame, counts: Store, delta: DataFrame) -> DataFrame:
    """facts() after a change, from those before it: rows of untouched columns are taken over, and the others come from
    their pairs in counts, which have the change already. delta: the cells that changed."""
    dirty = [r.column for r in delta.select("column").distinct().collect()]  # names of columns
    kept = before.where(~F.col("column").isin(dirty))
    pairs = _of(counts, dirty)
    return kept if pairs is None else kept.unionByName(facts(pairs))


def reading(diff: Diff) -> DataFrame:
    """column, equal, const_a, const_b, matched, a_only, b_only from one aggregate of the joined rows; a row for each
    comparable column, or one with a null column if there is none."""
    both = F.col("in_a") & F.col("in_b")
    kept = {"matched": F.count_if(both), "a_only": F.count_if(F.col("in_b").isNull()), "b_only": F.count_if(F.col("in_a").isNull())}
    return _reading(diff, diff.joined, both, kept)


def column_reading(diff: Diff) -> DataFrame:
    """column, equal, const_a, const_b of reading(), from the matched rows alone."""
    return _reading(diff, diff.matched, None, {})


def _reading(diff: Diff, rows: DataFrame, both: Column | None, kept: dict[str, Column]) -> DataFrame:
    columns, ends = diff.comparable, []
    of = lambda x: x if both is None else F.when(both, x)
    for i, h in enumerate(columns):
        a, b = F.col(diff.of_a[h]), F.col(diff.of_b[h])
        ends.append(F.count_if(a == b if both is None else both & (a == b)).alias(f"e{i}"))
        ends += [f(of(x)).alias(f"{name}{i}") for x, s in ((a, "a"), (b, "b")) for f, name in ((F.min, f"min_{s}"), (F.max, f"max_{s}"))]
    one = rows.agg(*(x.alias(k) for k, x in kept.items()), *(ends or [F.count("*").alias("rows")]))
    if not columns:
        return one.select(F.lit(None).cast("string").alias("column"), F.lit(0).cast("long").alias("equal"), F.lit(None).cast("string").alias("const_a"), F.lit(None).cast("string").alias("const_b"), *kept)
    only = lambda s, i: F.when(F.col(f"min_{s}{i}") == F.col(f"max_{s}{i}"), F.col(f"min_{s}{i}"))
    parts = [x for i, h in enumerate(columns) for x in (F.lit(h), F.col(f"e{i}"), only("a", i), only("b", i))]
    return one.select(F.stack(F.lit(len(columns)), *parts).alias("column", "equal", "const_a", "const_b"), *kept)
