"""Calendar dates in texts, if they can be read in one way only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English month names as numbers. Fixed values.
MONTHS = {"JAN": "01", "FEB": "02", "MAR": "03", "APR": "04", "MAY": "05", "JUN": "06", "JUL": "07", "AUG": "08", "SEP": "09", "OCT": "10", "NOV": "11", "DEC": "12"}

#: Layouts of fixed width that a text is tried against: y and Y are two and four digits of a year. Fixed values.
WRITTEN = ["Y-m-d", "Y-m-dTH:M:S", "m/d/Y", "d/m/Y", "Ymd", "m/d/y", "d/m/y"]
#: The same for texts whose month names have become numbers, whether they had any or not. Fixed values.
NAMED = ["dmY", "dmy", "d-m-Y", "mY", "my", "dmY:H:M:S", "dmy:H:M:S"]

#: What a text that any layout fits is made of: 4 to 19 characters, of which a month name stands for two. Most texts are
#: ruled out by it.
LIKELY = f"(?i)^(?:[0-9/:T-]|{'|'.join(MONTHS)}){{2,19}}\\z"

_WIDTH = {"Y": 4, "y": 2, "m": 2, "d": 2, "H": 2, "M": 2, "S": 2}
_PATTERN = {"Y": "[0-9]{4}", "y": "[0-9]{2}", "m": "[0-9]{2}", "d": "[0-9]{2}", "H": "([01][0-9]|2[0-3])", "M": "[0-5][0-9]", "S": "[0-5][0-9]"}


def with_month_numbers(x: Column) -> Column:
    """x with each month name, in any case, as two digits."""
    for name, digits in MONTHS.items():
        x = F.regexp_replace(x, f"(?i){name}", digits)
    return x


def _read(x: Column, layout: str) -> Column:
    """The date that x has in a layout, or null. A layout without a day gives the first of the month."""
    place, part = 1, {}
    for c in layout:
        if c in _WIDTH:
            part[c] = F.substring(x, place, _WIDTH[c])
        place += _WIDTH.get(c, 1)
    short = part.get("y")
    year = part["Y"] if short is None else F.concat(F.when(short >= "69", "19").otherwise("20"), short)
    text = F.concat(year, F.lit("-"), part["m"], F.lit("-"), part.get("d", F.lit("01")))
    fits = (F.length(x) == sum(_WIDTH.get(c, 1) for c in layout)) & x.rlike("^" + "".join(_PATTERN.get(c, c) for c in layout) + r"\z") & (year >= "0001")
    return F.when(fits, F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def calendar_date(x: Column) -> Column:
    """The one date that all layouts which fit x agree on, else null."""
    dates = lambda n: F.array_distinct(F.array_compact(F.array(*[_read(x, p) for p in WRITTEN], *[_read(n, p) for p in NAMED])))
    # arrays of one element: their functions read the month names, and the dates, once for all that ask
    found = F.filter(F.transform(F.array(with_month_numbers(x)), dates), lambda some: F.size(some) == 1)
    return F.when(x.rlike(LIKELY), F.get(F.get(found, F.lit(0)), F.lit(0)))


def serial_date(x: Column, date: Column) -> Column:
    """The date of a spreadsheet's day number from 0 to 99999, unless x has a calendar date itself."""
    n = F.when(x.rlike(r"^0*[0-9]{1,5}\z"), x.try_cast("int"))
    return F.when(n.isNotNull() & date.isNull(), F.date_add(F.lit("1899-12-30").cast("date"), n))
