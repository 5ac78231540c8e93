"""Summaries of cells. Frames hold column, val_a, val_b and, where rows matter, the keys k0.. of a Diff."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exactdiff.functions.checks import CHECKS, checked
from exactdiff.operators.diff import CELL, Diff

#: Distinct pending values at most of a categorical column: side A, side B, both together. Fixed values.
CATEGORICAL = (30, 30, 50)
#: Values of a context summary before the rest is counted.
TOP = 5
#: Parts that a pair's context values are dealt to.
SALTS = 32


def count_by_column(cells: DataFrame, name: str = "n") -> DataFrame:
    return cells.groupBy("column").agg(F.count("*").alias(name))


def pair_groups(cells: DataFrame) -> DataFrame:
    """column, val_a, val_b, n: how often each pair of values stands in each column."""
    return cells.groupBy("column", "val_a", "val_b").agg(F.count("*").alias("n"))


def pair_order() -> list[Column]:
    """Within a column: most frequent first, then by the values."""
    return [F.desc("n"), F.asc("val_a"), F.asc("val_b")]


def top_pairs(pairs: DataFrame) -> DataFrame:
    """Of pair_groups() the first pair of each column."""
    first = F.min(F.struct((-F.col("n")).alias("n"), "val_a", "val_b"))
    return pairs.groupBy("column").agg(first.alias("x")).select("column", "x.val_a", "x.val_b", (-F.col("x.n")).alias("n"))


def concentration(pairs: DataFrame) -> DataFrame:
    """column, pending, top_n, concentration: the share of a column's pending cells that its first pair has."""
    return pairs.groupBy("column").agg(F.sum("n").alias("pending"), F.max("n").alias("top_n")).withColumn("concentration", F.col("top_n") / F.col("pending"))


def union_pairs(cells: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """val_a, val_b, n, n_cols: pairs over several columns together."""
    some = cells if columns is None else cells.where(F.col("column").isin(list(columns)))
    # columns are few, so pairs are counted in each column first
    return pair_groups(some).groupBy("val_a", "val_b").agg(F.sum("n").alias("n"), F.count("*").alias("n_cols"))


def column_constants(diff: Diff) -> DataFrame:
    """column, const_a, const_b: a side's only value over all matched rows, else null. Least and greatest value of all
    columns come from one aggregation of the joined rows, without making cells of them."""
    columns = diff.comparable
    if not columns:
        return diff.matched.select(F.lit("").alias("column"), F.lit("").alias("const_a"), F.lit("").alias("const_b")).limit(0)
    ends = [f(F.col(c)).alias(f"{name}_{c}") for h in columns for c in (diff.of_a[h], diff.of_b[h]) for name, f in (("min", F.min), ("max", F.max))]
    only = lambda c: F.when(F.col(f"min_{c}") == F.col(f"max_{c}"), F.col(f"min_{c}"))
    parts = [x for h in columns for x in (F.lit(h), only(diff.of_a[h]), only(diff.of_b[h]))]
    return diff.matched.agg(*ends).select(F.stack(F.lit(len(columns)), *parts).alias("column", "const_a", "const_b"))


def categorical(pairs: DataFrame) -> DataFrame:
    """column, n_a, n_b, n_both, categorical (yes or no) from pending pair_groups()."""
    most_a, most_b, most = CATEGORICAL
    sides = pairs.select("column", F.explode(F.array(F.struct(F.lit("a").alias("s"), F.col("val_a").alias("v")), F.struct(F.lit("b").alias("s"), F.col("val_b").alias("v")))).alias("x"))
    values = sides.groupBy("column", "x.v").agg(F.bool_or(F.col("x.s") == "a").alias("in_a"), F.bool_or(F.col("x.s") == "b").alias("in_b"))
    counts = values.groupBy("column").agg(F.count_if("in_a").alias("n_a"), F.count_if("in_b").alias("n_b"), F.count("*").alias("n_both"))
    few = (F.col("n_a") <= most_a) & (F.col("n_b") <= most_b) & (F.col("n_both") <= most)
    return counts.withColumn("categorical", F.when(few, "yes").otherwise("no"))


def check_matrix(pairs: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """column and, for each check, y or n: whether it holds for all pending cells. Pairs stand for their cells, since
    how often a pair occurs doesn't matter; columns without pending cells have no row."""
    names = list(CHECKS) if names is None else list(names)
    found = checked(pairs.select("column", "val_a", "val_b"), names=names)
    return found.groupBy("column").agg(*(F.when(F.bool_and(f"`check_{k}`"), "y").otherwise("n").alias(k) for k in names))


def constant_columns(constants: DataFrame, pending: DataFrame, side: str, value: str) -> DataFrame:
    """column: pending columns whose constant on a side is the value exactly."""
    return pending.select("column").distinct().join(constants.where(F.col(f"const_{side.lower()}") == value).select("column"), "column")


def checking_columns(pairs: DataFrame, check: str) -> DataFrame:
    """column: pending columns of which a check holds for all pending cells."""
    return check_matrix(pairs, [check]).where(f"`{check}` = 'y'").select("column")


def context_value(x: Column) -> Column:
    return F.when(x == "", F.lit("(empty)")).otherwise(x)


def context_views(diff: Diff, column: str, views: Mapping[str, Sequence[str]], accepted: DataFrame | None = None, pairs: DataFrame | None = None, top: int = TOP) -> DataFrame:
    """view, column, val_a, val_b, summary: which context values stand beside a column's pending pairs, for several
    views in one pass over its cells, as `foo×12 | bar×4 | +N more`.

    views: by name, one context column each, or several whose values form a tuple joined by |. Both sides' values count,
    one that both sides of a row have only once; more frequent ones first, then by value. accepted: snapshots whose cells
    are left out; pairs: the pairs (val_a, val_b) to look at, a page of them at most."""

    def shown(names: dict[str, str], members: Sequence[str]) -> Column | None:
        return F.concat_ws("|", *(context_value(F.col(names[m])) for m in members)) if all(m in names for m in members) else None

    def values(members: Sequence[str]) -> Column:
        sides = [x for x in (shown(diff.of_a, members), shown(diff.of_b, members)) if x is not None]
        return F.array_distinct(F.array(*(sides or [shown(diff.of_b | diff.of_a, members)])))

    def named(name: str, found: Column) -> Column:
        return F.transform(found, lambda v: F.struct(F.lit(name).alias("view"), v.alias("value")))

    beside = F.flatten(F.array(*(named(name, values(m)) for name, m in views.items())))
    # the values go along with the cell that they stand beside, so the rows are not joined again
    cells = diff.matched.select(*diff.k, F.lit(column).alias("column"), F.col(diff.of_a[column]).alias("val_a"), F.col(diff.of_b[column]).alias("val_b"), beside.alias("beside")).where("val_a <> val_b")
    if pairs is not None:
        cells = cells.join(F.broadcast(pairs.select("val_a", "val_b").distinct()), ["val_a", "val_b"], "left_semi")
    if accepted is not None:
        identity = [*diff.k, *CELL]
        cells = cells.join(accepted.where(F.col("column") == column).select(*identity).distinct(), identity, "left_anti")
    value = cells.select("column", "val_a", "val_b", F.explode("beside").alias("x")).select("x.view", "column", "val_a", "val_b", "x.value")
    counted = value.groupBy("view", "column", "val_a", "val_b", "value").agg(F.count("*").alias("n"))
    pair = ["view", "column", "val_a", "val_b"]
    # the values of a pair are dealt to SALTS parts by their hash, each of which keeps its first ones, so that a pair with
    # very many values is no single task's work
    salt = F.pmod(F.xxhash64("value"), F.lit(SALTS)).alias("salt")
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "value"))
    first = counted.select("*", salt).withColumn("rank", rank(*pair, "salt")).where(F.col("rank") <= top)
    first = first.withColumn("rank", rank(*pair)).where(F.col("rank") <= top)
    item = F.struct("rank", F.concat("value", F.lit("×"), F.col("n").cast("string")).alias("text"))
    items = first.groupBy(*pair).agg(F.array_sort(F.collect_list(item)).alias("items"))
    out = items.join(counted.groupBy(*pair).agg(F.count("*").alias("values")), pair)
    text = F.array_join(F.transform("items", lambda x: x["text"]), " | ")
    more = F.when(F.col("values") > top, F.concat(F.lit(" | +"), (F.col("values") - top).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return out.select(*pair, F.concat(text, more).alias("summary"))


def context_summary(diff: Diff, column: str, members: Sequence[str], accepted: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """column, val_a, val_b, summary: context_views() with one view."""
    return context_views(diff, column, {"": members}, accepted, pairs).drop("view")


def equal_counts(diff: Diff) -> DataFrame:
    """column, equal: matched rows whose two values are the same text; one aggregation of the joined rows, without cells."""
    columns = diff.comparable
    if not columns:
        return diff.matched.select(F.lit("").alias("column"), F.lit(0).cast("long").alias("equal")).limit(0)
    counts = diff.matched.agg(*(F.count_if(F.col(diff.of_a[h]) == F.col(diff.of_b[h])).alias(f"n{i}") for i, h in enumerate(columns)), F.count("*").alias("all")).where("`all` > 0")
    return counts.select(F.stack(F.lit(len(columns)), *(x for i, h in enumerate(columns) for x in (F.lit(h), F.col(f"n{i}")))).alias("column", "equal"))


def overview(diff: Diff, pending: DataFrame, accepted: DataFrame) -> DataFrame:
    """One row of counts: matched, a_only, b_only, pending, accepted, pending_columns, extras."""
    kinds = diff.joined.agg(F.count_if(F.col("in_a") & F.col("in_b")).alias("matched"), F.count_if(F.col("in_b").isNull()).alias("a_only"), F.count_if(F.col("in_a").isNull()).alias("b_only"))
    cells = count_by_column(pending, "p").agg(F.coalesce(F.sum("p"), F.lit(0)).alias("pending"), F.count("*").alias("pending_columns"))
    done = accepted.agg(F.count("*").alias("accepted"))
    one = F.lit(1).alias("one")
    return kinds.select("*", one).join(cells.select("*", one), "one").join(done.select("*", one), "one").drop("one").withColumn("extras", F.lit(len(diff.extra_columns())).cast("long"))
