"""What a refresh shows: accepted differences that have moved since they were accepted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exactdiff.operators.diff import Diff


def returned_cells(diff: Diff, pending: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Pending cells whose key and column were accepted with other values."""
    return pending.join(snapshots.select(*diff.k, "column").distinct(), [*diff.k, "column"], "left_semi")


def returned_keys(diff: Diff, pending_rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Pending unmatched rows whose side and key were accepted with another row."""
    return pending_rows.join(snapshots.select("side", *diff.k).distinct(), ["side", *diff.k], "left_semi")


def marked(rows: DataFrame, hits: DataFrame | None, on: Sequence[str], name: str = "returned") -> DataFrame:
    """rows with a flag: whether they are among the hits."""
    if hits is None:
        return rows.withColumn(name, F.lit(False))
    return rows.join(hits.select(*on).distinct().withColumn(name, F.lit(True)), list(on), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def cells_marked(diff: Diff, pending: DataFrame, snapshots: DataFrame | None) -> DataFrame:
    """Pending cells with returned: whether their key and column were accepted with other values."""
    if snapshots is None:
        return pending.withColumn("returned", F.lit(False))
    known = snapshots.select(*diff.k, "column").distinct().withColumn("returned", F.lit(True))
    return pending.join(known, [*diff.k, "column"], "left").withColumn("returned", F.coalesce("returned", F.lit(False)))


def pairs_marked(marked: DataFrame) -> DataFrame:
    """column, val_a, val_b, n, returned: pair groups of cells_marked(), and whether any of a pair's cells has returned."""
    return marked.groupBy("column", "val_a", "val_b").agg(F.count("*").alias("n"), F.bool_or("returned").alias("returned"))


def rows_marked(diff: Diff, rows: DataFrame, snapshots: DataFrame | None) -> DataFrame:
    """Unmatched rows with accepted, whether a snapshot covers them as they are, and returned, whether one covers their key
    with another row."""
    if snapshots is None:
        return rows.withColumn("accepted", F.lit(False)).withColumn("returned", F.lit(False))
    key = ["side", *diff.k]
    same = snapshots.select(*key, "row").distinct().withColumn("accepted", F.lit(True))
    known = snapshots.select(*key).distinct().withColumn("known", F.lit(True))
    found = rows.join(same, [*key, "row"], "left").join(known, key, "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    return found.withColumn("returned", F.coalesce("known", F.lit(False)) & ~F.col("accepted")).drop("known")


def unchecked_after(before: DataFrame, now: DataFrame, unchecked: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """The keys that a pair draft leaves unchecked after a refresh: those that were and are still there, and those that
    have come since, which nobody has looked at. before, now: the draft's cells in both readings."""
    came = now.select(*keys).join(before.select(*keys), list(keys), "left_anti")
    return came if unchecked is None else came.unionByName(now.select(*keys).join(unchecked.select(*keys), list(keys), "left_semi"))
