"""Accepted differences, as snapshots of exactly what was accepted.

A cell's snapshot is (keys, column, val_a, val_b); an unmatched row's is its side, keys and full row as JSON, so that a
column that comes or goes between two readings makes it another row; an extra column's is (side, name). A snapshot
covers a difference only while that difference is unchanged, and stays in the store, so that a value which comes back is
accepted again. Frames in the store are append-only; only what is new is compared with it before it is added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exactdiff.operators.diff import CELL, Diff


def cell_identity(diff: Diff) -> list[str]:
    return [*diff.k, *CELL]


def split(current: DataFrame, snapshots: DataFrame | None, identity: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The pending and the accepted rows of current."""
    if snapshots is None:
        return current, current.limit(0)
    known = snapshots.select(*identity).distinct()
    return current.join(known, list(identity), "left_anti"), current.join(known, list(identity), "left_semi")


def marked_cells(diff: Diff, snapshots: DataFrame) -> DataFrame:
    """The unequal cells of diff, with known__: whether a snapshot covers them. Snapshots meet the joined rows by their keys,
    a set for each row, before cells are made of these, so that cells are neither shuffled nor sorted."""
    known = snapshots.groupBy(*diff.k).agg(F.collect_set(F.struct(*CELL)).alias("known__"))
    cells = diff.tall(diff.matched.join(known, diff.k, "left"), beside=["known__"]).where("val_a <> val_b")
    return cells.withColumn("known__", F.coalesce(F.array_contains("known__", F.struct(*CELL)), F.lit(False)))


def split_cells(diff: Diff, snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pending and the accepted cells of diff."""
    cells = marked_cells(diff, snapshots)
    return cells.where(~F.col("known__")).drop("known__"), cells.where("known__").drop("known__")


def accepting(diff: Diff, snapshots: DataFrame, some: Column) -> DataFrame:
    """The pending cells of diff, and whether an accept of some adds them or leaves them pending."""
    return split_cells(diff, snapshots)[0].withColumn("added", F.coalesce(some, F.lit(False)))


def add(snapshots: DataFrame | None, new: DataFrame, identity: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The store with what is new in `new`, and that part alone."""
    delta = new.select(*identity).distinct()
    if snapshots is None:
        return delta, delta
    delta = delta.join(snapshots.select(*identity), list(identity), "left_anti")
    return snapshots.unionByName(delta), delta


def remove(snapshots: DataFrame, gone: DataFrame, identity: Sequence[str]) -> DataFrame:
    return snapshots.join(gone.select(*identity).distinct(), list(identity), "left_anti")


def of_column(cells: DataFrame, column: str) -> DataFrame:
    return cells.where(F.col("column") == column)


def of_pair(cells: DataFrame, val_a: str, val_b: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The cells with exactly these two values, of some columns or all."""
    return cells.where(is_pair(val_a, val_b, columns))


def is_pair(val_a: str, val_b: str, columns: Sequence[str] | None = None) -> Column:
    """Whether a cell has exactly these two values, in some columns or any."""
    found = (F.col("val_a") == val_a) & (F.col("val_b") == val_b)
    return found if columns is None else found & F.col("column").isin(list(columns))


def minus(cells: DataFrame, unchecked: DataFrame, diff: Diff) -> DataFrame:
    """cells of which some rows, given by their keys, are left out."""
    return cells.join(unchecked.select(*diff.k), diff.k, "left_anti")


def unmatched(diff: Diff, side: str) -> DataFrame:
    """side, k0.., row: the rows of one side only, each as JSON in the order of its header names."""
    names = diff.of_a if side == "A" else diff.of_b
    at = dict(zip(diff.keys, diff.k)) | names
    row = F.to_json(F.array(*(F.struct(F.lit(h).alias("n"), F.col(at[h]).alias("v")) for h in sorted(at))))
    return diff.only(side).select(F.lit(side).alias("side"), *diff.k, row.alias("row"))


def unmatched_identity(diff: Diff) -> list[str]:
    return ["side", *diff.k, "row"]
