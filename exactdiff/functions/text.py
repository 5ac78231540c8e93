"""Text functions over the whole of Unicode, all of them JVM expressions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a class: Unicode's, and the four separators that only some languages count.
SPACE = r"[\s\x{1C}-\x{1F}]"


def strip(x: Column) -> Column:
    """x without white space at either end. SQL's trim takes spaces only."""
    return F.regexp_replace(x, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def squeeze(x: Column) -> Column:
    """x with each run of white space as one space."""
    return F.regexp_replace(x, rf"(?U){SPACE}+", " ")


#: Code points that are written as dashes. Fixed values.
DASHES = "‐‑‒–—―−﹘﹣－"


def plain_dashes(x: Column) -> Column:
    return F.translate(x, DASHES, "-" * len(DASHES))


def unmarked(x: Column) -> Column:
    """x in compatibility decomposition without its marks. ICU comes with Spark; ASCII text needs none of it."""
    apart = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), x, F.lit(True))
    return F.when(F.octet_length(x) == F.length(x), x).otherwise(F.regexp_replace(apart, r"\p{M}+", ""))


def number(x: Column) -> Column:
    """x, stripped, as a double if it is written as a decimal number; else null. Neither nan, inf, suffixes nor digit
    separators count."""
    s = strip(x)
    return F.when(s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), s.try_cast("double"))


def first_difference(a: Column, b: Column) -> Column:
    """The 0-based place of the first code point in which a and b differ; the shorter length if one begins the other.

    Halving: the longest common beginning is found in as many steps as its length has bits, which are 31 at most."""
    least = F.least(F.length(a), F.length(b))

    def halve(low: Column, step: Column) -> Column:
        # a step is taken only where it fits, so the sum never overflows
        longer = F.when(step <= least - low, low + step)
        return F.when(longer.isNotNull() & (F.substring(a, F.lit(1), longer) == F.substring(b, F.lit(1), longer)), longer).otherwise(low)

    return F.aggregate(F.array(*(F.lit(1 << k) for k in range(30, -1, -1))), F.lit(0), halve)


#: What stands for characters that can't be seen: no-break and other spaces, tabs, line breaks. Fixed values.
SHOWN = {"\u00a0": "␣", "\t": "→", "\r": "␍", "\n": "↵", "\v": "↵", "\f": "↵"}
#: Characters of a text that a list shows.
WIDTH = 32


def visible(x: Column) -> Column:
    """x with a sign, one character long, for each character that can't be seen: spaces at either end and odd white space;
    an empty text is (empty)."""
    ends = F.regexp_extract(x, "^ *", 0), F.regexp_extract(x, " *\\z", 0)
    dots = lambda s: F.repeat(F.lit("·"), F.length(s))
    middle = F.substring(x, F.length(ends[0]) + 1, F.length(x) - F.length(ends[0]) - F.length(ends[1]))
    plain = F.regexp_replace(F.translate(middle, "".join(SHOWN), "".join(SHOWN.values())), r"(?! )\p{Zs}", "␣")
    return F.when(x == "", "(empty)").when(F.length(ends[0]) == F.length(x), dots(x)).otherwise(F.concat(dots(ends[0]), plain, dots(ends[1])))


def window(x: Column, at: Column, width: int = WIDTH) -> Column:
    """At most width characters of a text around a place, counted from 0, with … where something is cut off. Text from the
    beginning is shown as long as the place is within it."""
    n, at = F.length(x), F.least(at, F.length(x))
    begin = F.greatest(F.lit(1), F.least(at - width // 2, n - (width - 1)))
    tail = F.concat(F.substring(x, F.lit(1), F.lit(width - 1)), F.lit("…"))
    end_cut = begin + (width - 1) < n
    inner = F.when(end_cut, F.concat(F.lit("…"), F.substring(x, begin + 1, F.lit(width - 2)), F.lit("…"))).otherwise(F.concat(F.lit("…"), F.substring(x, begin + 1, F.lit(width - 1))))
    return F.when(n <= width, x).when(at < width - 1, tail).otherwise(inner)


def pair_text(a: Column, b: Column, width: int = WIDTH) -> tuple[Column, Column]:
    """Both texts of a pair as a list shows them, each cut around the first character in which they differ."""
    at = first_difference(a, b)
    return tuple(window(visible(x), F.when(x == "", F.lit(0)).otherwise(at), width) for x in (a, b))


def constant_text(a: str | None, b: str | None) -> str:
    """A column's constants as the roster shows them: `A=x`, `B=y`, both, or nothing. Texts that would not show as they are
    stand in quotes."""

    def shown(x: str) -> str:
        plain = x != "" and not any(c.isspace() or c in "=\"'" for c in x)
        return x if plain else '"' + re.sub(r'(["\\])', r"\\\1", x) + '"'

    return " ".join(f"{side}={shown(x)}" for side, x in (("A", a), ("B", b)) if x is not None)


def top_text(values: Iterable[str], top: int = 5) -> str:
    """The most frequent of some values with how often each occurs, as summaries show them: `foo×12 | bar×4 | +N more`."""
    ranked = sorted(Counter(values).items(), key=lambda x: (-x[1], x[0]))
    parts = [f"{v or '(empty)'}×{n}" for v, n in ranked[:top]]
    return " | ".join(parts + [f"+{len(ranked) - top} more"] * (len(ranked) > top))
