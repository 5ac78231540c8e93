"""Pages: bounded slices of totally ordered frames, the only rows of a tall frame that Python ever holds."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from exactdiff.lineage import cut, written
from exactdiff.operators.diff import Diff

SIZE = 100


def page_frame(df: DataFrame, order: Sequence[Column | str], page: int, size: int = SIZE) -> DataFrame:
    """Rows page * size and on, size at most; Spark keeps no more than (page + 1) * size rows of each partition."""
    if not 0 < size <= SIZE:
        raise ValueError(f"a page has 1 to {SIZE} rows")
    return df.orderBy(*order).offset(page * size).limit(size)


def page(df: DataFrame, order: Sequence[Column | str], number: int, size: int = SIZE) -> tuple[list[Row], int, int]:
    """The rows of a page, its number brought into range, and the number of pages, 1 at least."""
    pages = max(1, -(-df.count() // size))
    number = min(max(number, 0), pages - 1)
    return page_frame(df, order, number, size).collect(), number, pages


class Ordered:
    """A frame sorted once by a total order and written with each row's number, so that every page costs the same.

    Rows are dealt to ranges of the order and sorted there, and Parquet keeps the least and the greatest number and order
    value of each group of rows: that is the sparse index in which a page or a row is sought. The driver holds how many
    rows each range has, and nothing of the rows. order: (column, ascending)."""

    def __init__(self, df: DataFrame, order: Sequence[tuple[str, bool]]) -> None:
        self.order = list(order)
        sort = [F.asc(c) if up else F.desc(c) for c, up in self.order]
        self.at = "at__"
        dealt = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
        self.frame = written(dealt.withColumn(self.at, F.monotonically_increasing_id()))
        sizes = sorted(map(tuple, self.frame.groupBy(F.shiftright(self.at, 33)).count().collect()))
        self.starts, self.n = [], 0
        for part, size in sizes:
            self.starts.append((part, self.n, size))
            self.n += size

    def pages(self, size: int = SIZE) -> int:
        """The number of pages, 1 at least."""
        return max(1, -(-self.n // size))

    def _between(self, first: int, end: int) -> Column:
        """Whether a row is one of first, first + 1, ... before end, as ranges of the written number."""
        hit = F.lit(False)
        for part, start, size in self.starts[self._range(first) : self._range(end - 1) + 1] if end > first else []:
            lo, hi = max(first, start) - start, min(end, start + size) - start
            hit = hit | F.col(self.at).between((part << 33) + lo, (part << 33) + hi - 1)
        return hit

    def _range(self, place: int) -> int:
        return max(0, bisect_right(self.starts, place, key=lambda x: x[1]) - 1)

    def page_frame(self, number: int, size: int = SIZE) -> DataFrame:
        """The rows of a page in order; a page beyond the last one is empty."""
        if not 0 < size <= SIZE:
            raise ValueError(f"a page has 1 to {SIZE} rows")
        found = self.frame.where(self._between(number * size, min((number + 1) * size, self.n)))
        return found.orderBy(self.at).drop(self.at)

    def page(self, number: int, size: int = SIZE) -> tuple[list[Row], int, int]:
        """The rows of a page, its number brought into range, and the number of pages."""
        number = min(max(number, 0), self.pages(size) - 1)
        return self.page_frame(number, size).collect(), number, self.pages(size)

    def placed(self, where: Column | None = None) -> DataFrame:
        """The rows, or those for which a condition on the order's columns holds, with place: their number, from 0."""
        some = self.frame if where is None else self.frame.where(where)
        if not self.starts:
            return some.select("*", F.lit(0).cast("long").alias("place")).drop(self.at)
        start = F.element_at(F.map_from_arrays(F.lit([x[0] for x in self.starts]).cast("array<long>"), F.lit([x[1] for x in self.starts]).cast("array<long>")), F.shiftright(self.at, 33))
        return some.withColumn("place", start + F.col(self.at).bitwiseAND((1 << 33) - 1)).drop(self.at)

    def page_of(self, row: dict, size: int = SIZE) -> tuple[int, int] | None:
        """The page of a row, given by some of the order's columns, and its number there; None if it isn't there."""
        where = reduce(Column.__and__, (F.col(c) == v for c, v in row.items()))
        found = self.placed(where).agg(F.min("place")).first()[0]
        return None if found is None else divmod(found, size)

    def beside(self, row: dict, size: int = SIZE) -> Row | None:
        """The row behind the given one, else the one before it, else None: where to go when it is done."""
        at = self.page_of(row, size)
        if at is None:
            return None
        place = at[0] * size + at[1]
        for k in (place + 1, place - 1):
            if 0 <= k < self.n:
                return self.frame.where(self._between(k, k + 1)).drop(self.at).first()
        return None


def with_context(diff: Diff, rows: DataFrame, members: Sequence[str]) -> DataFrame:
    """A page's rows with what stands beside them: for each member its value on either side, as a0__, b0__ and so on in the
    order of members; null where a side lacks the column. Each side is narrowed to the page's keys before anything is
    joined, so neither is shuffled."""
    # a page has SIZE rows at most, which bounds all broadcasts; it is computed once
    page = cut(rows.limit(SIZE))
    keys = page.select(*diff.k).distinct()
    out = page
    for side, source, of in (("a", diff.a, diff.of_a), ("b", diff.b, diff.of_b)):
        named = source.frame.select(*(F.col(source.at(h)).alias(k) for h, k in zip(diff.keys, diff.k)), *((F.col(source.at(m)) if m in of else F.lit(None).cast("string")).alias(f"{side}{i}__") for i, m in enumerate(members)))
        found = named.join(F.broadcast(keys), diff.k, "left_semi")
        out = out.join(F.broadcast(found), diff.k, "left")  # a side has a key once, so found is no larger than the page
    return out


def after(df: DataFrame, columns: Sequence[str], values: Sequence) -> DataFrame:
    """The first row, by columns, that lies strictly behind the values; else the last row; none if df is empty."""
    here = F.struct(*(F.lit(v).alias(c) for c, v in zip(columns, values)))
    behind = F.struct(*columns) > here
    ranked = df.withColumn("__behind", behind)
    best = ranked.agg(F.min(F.when(F.col("__behind"), F.struct(*columns))).alias("next"), F.max(F.struct(*columns)).alias("last"))
    return best.select(F.coalesce("next", "last").alias("x")).where("x is not null").select("x.*")


def place(df: DataFrame, order: Sequence[tuple[str, bool]], row: dict, size: int = SIZE) -> int:
    """The number of the page that holds a row of df; order: (column, ascending). It counts the rows before it."""
    before, same = F.lit(False), F.lit(True)
    for c, up in order:
        x = F.col(c)
        before = before | (same & ((x < row[c]) if up else (x > row[c])))
        same = same & (x == row[c])
    return df.where(before).count() // size


def neighbours(pairs: DataFrame, val_a: str, val_b: str) -> DataFrame:
    """One row of structs next, previous, first, last (val_a, val_b, n): a pair's neighbours in the order of pairs (most
    frequent first, then by the values) and that order's ends, from one aggregate. Where the pair itself is not among
    the pairs, it has no neighbours."""
    here = pairs.where((F.col("val_a") == val_a) & (F.col("val_b") == val_b)).select("n").head()
    place = lambda n, a, b: F.struct((-n).alias("n"), a.alias("val_a"), b.alias("val_b"))
    x = place(F.col("n"), F.col("val_a"), F.col("val_b"))
    own = F.lit(None).cast("struct<n: bigint, val_a: string, val_b: string>") if here is None else place(F.lit(here.n).cast("long"), F.lit(val_a), F.lit(val_b))
    found = pairs.agg(F.min(F.when(x > own, x)).alias("next"), F.max(F.when(x < own, x)).alias("previous"), F.min(x).alias("first"), F.max(x).alias("last"))
    shown = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.val_a").alias("val_a"), F.col(f"{c}.val_b").alias("val_b"), (-F.col(f"{c}.n")).alias("n"))).alias(c)
    return found.select(*map(shown, ("next", "previous", "first", "last")))


def pair_beside(pairs: DataFrame, val_a: str, val_b: str) -> DataFrame:
    """val_a, val_b, n of the pair below the given one, else of the one above it; no row if neither is there."""
    return neighbours(pairs, val_a, val_b).select(F.coalesce("next", "previous").alias("x")).where("x is not null").select("x.*")
