"""The checks: fifteen predicates over two unequal texts. They describe; they never change what counts as equal.

Each is one Spark expression, used for a column's whole set of pairs and for a single pair alike. `CHECKS` gives them
in their fixed order as functions of a `Sides`, whose dates are read once for the two checks that need them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exactdiff.functions.dates import calendar_date, serial_date
from exactdiff.functions.text import number, plain_dashes, squeeze, strip, unmarked

#: Texts that state a truth value, lower case. Fixed values.
TRUTHS = ["y", "yes", "true", "t", "1", "n", "no", "false", "f", "0"]


class Sides:
    """The two texts, and the columns that hold their dates."""

    def __init__(self, a: Column, b: Column, date_a: Column | None = None, date_b: Column | None = None) -> None:
        self.a, self.b = a, b
        self.date_a = calendar_date(a) if date_a is None else date_a
        self.date_b = calendar_date(b) if date_b is None else date_b


def _same(f: Callable[[Column], Column]) -> Callable[[Sides], Column]:
    return lambda s: f(s.a) == f(s.b)


def _money(s: Sides) -> Column:
    a, b = (F.regexp_replace(x, "[$€£, ]", "") for x in (s.a, s.b))
    return ((a != s.a) | (b != s.b)) & (number(a) == number(b))


def _share(x: Column) -> Column:
    x = strip(x)
    return F.when(x.endswith("%"), number(F.regexp_replace(x, r"%\z", "")) / 100.0).otherwise(number(x))


def _percent(s: Sides) -> Column:
    return (strip(s.a).endswith("%") | strip(s.b).endswith("%")) & (_share(s.a) == _share(s.b))


def _padded(s: Sides) -> Column:
    digits = s.a.rlike(r"^[0-9]+\z") & s.b.rlike(r"^[0-9]+\z")
    return digits & (F.regexp_replace(s.a, "^0+", "") == F.regexp_replace(s.b, "^0+", ""))


def _accounting(s: Sides) -> Column:
    boxed = lambda x: strip(x).rlike(r"(?s)^\(.*\)\z")
    value = lambda x: F.when(boxed(x), number(F.concat(F.lit("-"), strip(F.regexp_extract(strip(x), r"(?s)^\((.*)\)\z", 1))))).otherwise(number(x))
    return (boxed(s.a) | boxed(s.b)) & (value(s.a) == value(s.b))


def _spreadsheet(s: Sides) -> Column:
    a, b = serial_date(s.a, s.date_a), serial_date(s.b, s.date_b)
    return (F.coalesce(s.date_a, a) == F.coalesce(s.date_b, b)) & (a.isNotNull() | b.isNotNull())


def _spaced(s: Sides) -> Column:
    odd = lambda x: x.rlike(r"[\x{A0}\t\r\n]") | (x != strip(x))
    return odd(s.a) | odd(s.b)


CHECKS: dict[str, Callable[[Sides], Column]] = {
    "trim": _same(strip),
    "case": _same(F.lower),
    "trim+case": _same(lambda x: F.lower(strip(x))),
    "num": _same(number),
    "ws": _spaced,
    "date": lambda s: s.date_a == s.date_b,
    "money": _money,
    "pct": _percent,
    "idpad": _padded,
    "bool": lambda s: F.lower(s.a).isin(TRUTHS) & F.lower(s.b).isin(TRUTHS),
    "acctneg": _accounting,
    "xlsdate": _spreadsheet,
    "inws": _same(squeeze),
    "dash": _same(plain_dashes),
    "fold": _same(unmarked),
}


def checked(pairs: DataFrame, a: str = "val_a", b: str = "val_b", names: list[str] | None = None, prefix: str = "check_") -> DataFrame:
    """pairs with a boolean for each check, never null."""
    dated = pairs.withColumn("__date_a", calendar_date(F.col(a))).withColumn("__date_b", calendar_date(F.col(b)))
    s = Sides(F.col(a), F.col(b), F.col("__date_a"), F.col("__date_b"))
    return dated.select(*(F.col(f"`{c}`") for c in pairs.columns), *(F.coalesce(f(s), F.lit(False)).alias(f"{prefix}{k}") for k, f in CHECKS.items() if names is None or k in names))


def pair_tags(pairs: DataFrame) -> DataFrame:
    """pairs with `tags`, the checks that hold for a single pair: trim+case only if neither trim nor case does, ws never."""
    found = checked(pairs)
    tag = {k: F.col(f"`check_{k}`") for k in CHECKS if k != "ws"}
    tag["trim+case"] = tag["trim+case"] & ~tag["trim"] & ~tag["case"]
    return found.select(*(F.col(f"`{c}`") for c in pairs.columns), F.array_compact(F.array(*(F.when(x, F.lit(k)) for k, x in tag.items()))).alias("tags"))
