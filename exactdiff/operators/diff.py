"""The exact difference of two keyed tables.

A side is a table of texts without nulls. One full outer join on the keys gives everything: keys of one side only,
matched rows, and the cells of matched rows as a tall table. Inside, columns go by position (`k0..` keys, `a0..` and
`b0..` values), so no header, whatever its name or case, can clash with another or with a name of this package; names
come back at the border, where a key is a struct `key` unless its names are free to stand beside the other columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exactdiff.errors import HardFail, key_text

CELL = ("column", "val_a", "val_b")
#: Bits of the filter that rows of one side only pass before they are shuffled, as a power of two: 8 MB at any size.
FILTER = 26
#: The same of one of its rows, which bitmap_construct_agg fixes.
BITMAP = 15


@dataclass(frozen=True)
class Side:
    """Headers as read, and a frame of texts in their order whose columns are named c0, c1, ..."""

    headers: tuple[str, ...]
    frame: DataFrame

    @classmethod
    def of(cls, df: DataFrame, headers: Sequence[str] | None = None) -> Side:
        """df as texts: null becomes the empty text, and rows of empty texts only are dropped."""
        headers = tuple(df.columns if headers is None else headers)
        if not headers:
            raise HardFail("a side needs a header row")
        plain = df.toDF(*(f"c{i}" for i in range(len(headers))))
        plain = plain.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in plain.columns))
        return cls(headers, plain.where(reduce(Column.__or__, (F.col(c) != "" for c in plain.columns))))

    def at(self, name: str) -> str:
        return f"c{self.headers.index(name)}"


def duplicate_keys(side: Side, keys: Sequence[str]) -> DataFrame:
    """k0.., n: the keys that more than one row has."""
    named = side.frame.select(*(F.col(side.at(k)).alias(f"k{i}") for i, k in enumerate(keys)))
    return named.groupBy(*named.columns).agg(F.count("*").alias("n")).where("n > 1")


class Diff:
    """The difference of sides a and b on keys."""

    def __init__(self, a: Side, b: Side, keys: Sequence[str]) -> None:
        for name, side in (("A", a), ("B", b)):
            twice = [h for i, h in enumerate(side.headers) if h in side.headers[:i]]
            if twice:
                raise HardFail(f"side {name} has two columns named {twice[0]!r}")
        for name, side in (("A", a), ("B", b)):
            missing = [k for k in keys if k not in side.headers]
            if missing:
                raise HardFail(f"side {name} lacks the key column {missing[0]!r}")
        self.a, self.b, self.keys = a, b, tuple(keys)
        both = [h for h in a.headers if h in b.headers]
        self.comparable = [h for h in both if h not in keys]
        self.extras_a = [h for h in a.headers if h not in b.headers]
        self.extras_b = [h for h in b.headers if h not in a.headers]
        #: All columns whose values may be shown beside a pair, in A's order and then B's.
        self.context = [*self.comparable, *self.extras_a, *self.extras_b]
        self.k = [f"k{i}" for i in range(len(keys))]
        self.of_a = {h: f"a{i}" for i, h in enumerate(h for h in a.headers if h not in keys)}
        self.of_b = {h: f"b{i}" for i, h in enumerate(h for h in b.headers if h not in keys)}

    def check_keys(self) -> None:
        """HardFail if a key of either side occurs twice; the first such key in order is named."""
        for name, side in (("A", self.a), ("B", self.b)):
            for row in duplicate_keys(side, self.keys).orderBy(*self.k).limit(1).collect():
                raise HardFail(f"side {name} has the key {key_text(tuple(row[:-1]))} on {row.n} rows")

    @cached_property
    def joined(self) -> DataFrame:
        """k0.., in_a, in_b, a0.., b0..: one row for each key; the flags are null where a side lacks it."""
        left = self.a.frame.select(*(F.col(self.a.at(h)).alias(k) for h, k in zip(self.keys, self.k)), F.lit(True).alias("in_a"), *(F.col(self.a.at(h)).alias(c) for h, c in self.of_a.items()))
        right = self.b.frame.select(*(F.col(self.b.at(h)).alias(k) for h, k in zip(self.keys, self.k)), F.lit(True).alias("in_b"), *(F.col(self.b.at(h)).alias(c) for h, c in self.of_b.items()))
        return left.join(right, self.k, "full")

    @cached_property
    def matched(self) -> DataFrame:
        return self.joined.where("in_a and in_b")

    def only(self, side: str) -> DataFrame:
        """k0.. and the values (named as in of_a or of_b) of the rows whose key the other side lacks.

        Keys are compared first. Whole rows are shuffled only if a filter of fixed size, made of the keys found, lets them
        pass; the keys themselves decide afterwards."""
        wanted, other, names = ("in_a", "in_b", self.of_a) if side == "A" else ("in_b", "in_a", self.of_b)
        if "joined" in self.__dict__ and self.joined.is_cached:
            return self.joined.where(f"{wanted} and {other} is null").select(*self.k, *names.values())
        own, rest = (self.a, self.b) if side == "A" else (self.b, self.a)
        keyed = lambda s: s.frame.select(*(F.col(s.at(h)).alias(k) for h, k in zip(self.keys, self.k)))
        # distinct, so that an inner join keeps rows as they are; Spark would take a semi join in front of the filter
        alone = keyed(own).join(keyed(rest), self.k, "left_anti").distinct()
        at = F.xxhash64(*self.k).bitwiseAND((1 << FILTER) - 1)
        place, bit = F.shiftright(at, BITMAP), at.bitwiseAND((1 << BITMAP) - 1)
        bits = alone.select(place.alias("place__"), bit.alias("bit__")).groupBy("place__").agg(F.bitmap_construct_agg("bit__").alias("bits__"))
        byte = F.conv(F.hex(F.substring("bits__", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.getbit(byte.cast("long"), bit.bitwiseAND(7).cast("int")) == 1
        rows = own.frame.select(*(F.col(own.at(h)).alias(k) for h, k in zip(self.keys, self.k)), *(F.col(own.at(h)).alias(c) for h, c in names.items()))
        near = rows.withColumn("place__", place).join(F.broadcast(bits), "place__").where(hit)
        return near.join(alone, self.k).select(*self.k, *names.values())

    def only_named(self, side: str) -> DataFrame:
        """The same with the side's own headers, keys in their places."""
        own, names = (self.a, self.of_a) if side == "A" else (self.b, self.of_b)
        at = dict(zip(self.keys, self.k)) | names
        return self.only(side).select(*(F.col(at[h]).alias(h) for h in own.headers))

    def tall(self, rows: DataFrame, columns: Sequence[str] | None = None, beside: Sequence[str] = ()) -> DataFrame:
        """k0.., column, val_a, val_b: the cells of matched rows; beside: further columns of the rows that come along."""
        columns = self.comparable if columns is None else columns
        if not columns:
            return rows.select(*self.k, *beside, *(F.lit("").alias(c) for c in CELL)).limit(0)
        parts = [x for h in columns for x in (F.lit(h), F.col(self.of_a[h]), F.col(self.of_b[h]))]
        return rows.select(*self.k, *beside, F.stack(F.lit(len(columns)), *parts).alias(*CELL))

    @cached_property
    def cells(self) -> DataFrame:
        return self.tall(self.matched)

    @cached_property
    def mismatches(self) -> DataFrame:
        return self.cells.where("val_a <> val_b")

    def named(self, df: DataFrame) -> DataFrame:
        """df with its keys under their headers, or as a struct if a header is taken by another column."""
        rest = [c for c in df.columns if c not in self.k]
        if {k.lower() for k in self.keys} & {c.lower() for c in rest} or len({k.lower() for k in self.keys}) < len(self.keys):
            return df.select(F.struct(*(F.col(c).alias(h) for h, c in zip(self.keys, self.k))).alias("key"), *(F.col(f"`{c}`") for c in rest))
        return df.select(*(F.col(c).alias(h) for h, c in zip(self.keys, self.k)), *(F.col(f"`{c}`") for c in rest))

    def classification(self) -> DataFrame:
        """k0.., kind: matched, a_only or b_only."""
        return self.joined.select(*self.k, F.when(F.col("in_b").isNull(), "a_only").when(F.col("in_a").isNull(), "b_only").otherwise("matched").alias("kind"))

    def extra_columns(self) -> list[tuple[str, str]]:
        """(name, side) of the headers that one side has, by name and then side."""
        return sorted([(h, "A") for h in self.extras_a] + [(h, "B") for h in self.extras_b])
