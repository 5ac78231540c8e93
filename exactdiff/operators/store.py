"""Stores that grow by signed rows and stay a bounded number of written parts.

A store holds amounts for identities: each part is a Parquet folder with a row for each identity that it touches, and what
the store holds is the sum over its parts. Adding costs what is added; taking away adds the same rows with the other sign.
When a part is at least half as large as the one before it, the two become one, so there are never more parts than the
number of rows has bits, each row is written again as many times at most, and a plan over the store keeps its size
however many changes there were. Parts are sorted by identity, so a filter on its first columns reaches the row groups
that hold them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exactdiff.lineage import written


@dataclass(frozen=True)
class Part:
    frame: DataFrame
    rows: int


@dataclass(frozen=True)
class Store:
    """identity: the columns that name a row; amounts: long columns that add up."""

    identity: tuple[str, ...]
    amounts: tuple[str, ...]
    parts: tuple[Part, ...] = ()

    def _summed(self, frames: Sequence[DataFrame]) -> DataFrame:
        added = reduce(DataFrame.unionByName, frames).groupBy(*self.identity).agg(*(F.sum(a).alias(a) for a in self.amounts))
        return added.where(reduce(Column.__or__, (F.col(a) != 0 for a in self.amounts)))

    def _part(self, frames: Sequence[DataFrame]) -> Part:
        frame = written(self._summed(frames).sortWithinPartitions(*self.identity))
        return Part(frame, frame.count())  # read from the files' footers

    def plus(self, rows: DataFrame) -> Store:
        """The store with some rows, of any number for an identity, added to it."""
        new = self._part([rows.select(*self.identity, *(F.col(a).cast("long").alias(a) for a in self.amounts))])
        if not new.rows:
            return self
        parts = [*self.parts, new]
        while len(parts) > 1 and 2 * parts[-1].rows >= parts[-2].rows:
            parts[-2:] = [self._part([p.frame for p in parts[-2:]])]
        return replace(self, parts=tuple(p for p in parts if p.rows))

    def current(self, where: Column | None = None) -> DataFrame | None:
        """Identities whose amounts are not all 0, of those for which a condition on the identity holds; None if the
        store never had a row."""
        if not self.parts:
            return None
        return self._summed([p.frame if where is None else p.frame.where(where) for p in self.parts])

    def rows(self) -> int:
        found = self.current()
        return 0 if found is None else found.count()


def signed(rows: DataFrame, identity: Sequence[str], sign: int) -> DataFrame:
    """Rows of a store with one amount n, which counts them."""
    return rows.select(*identity).distinct().withColumn("n", F.lit(sign).cast("long"))
