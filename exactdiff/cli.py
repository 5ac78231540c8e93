"""`python -m exactdiff.cli`: loads both sides, prints what differs, and exits with 0 (nothing), 1 (something) or 2."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from exactdiff.errors import HardFail
from exactdiff.session import Session
from exactdiff.sources import options
from exactdiff.sources.load import check_sheets, source


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="exactdiff", description="Strict comparison of two keyed tables. Sources are only read.")
    for side in "ab":
        p.add_argument(f"--{side}", help=f"file of side {side.upper()}")
        p.add_argument(f"--{side}-sheet", help="its sheet, if it is a workbook")
        p.add_argument(f"--{side}-delim", help="its delimiter, if it is not a workbook (comma for .csv)")
        p.add_argument(f"--{side}-encoding", help="its encoding, if it is not a workbook (utf8)")
    p.add_argument("-sheets", "--sheets", help="sheets of both workbooks, one after the other: data{1-4,7} or Jan,Feb")
    p.add_argument("--keys", help="names of the key columns, between commas")
    return p


def open_session(spark: SparkSession, n: argparse.Namespace) -> Session:
    if not n.a or not n.b or not n.keys:
        raise HardFail("a job needs --a and --b, its two files, and --keys")
    keys = options.keys(n.keys)
    if n.sheets is not None:
        if n.a_sheet or n.b_sheet:
            raise HardFail("--sheets excludes --a-sheet and --b-sheet")
        sheets = options.sheets(n.sheets)
        check_sheets({"A": n.a, "B": n.b}, sheets)
        n.a_sheet = n.b_sheet = sheets[0]
    else:
        sheets = []
    a = source(n.a, "A", n.a_sheet, n.a_delim, n.a_encoding)
    b = source(n.b, "B", n.b_sheet, n.b_delim, n.b_encoding)
    return Session.of_sources(spark, a, b, keys, sheets)


def report(s: Session) -> None:
    for name, n in s.overview().items():
        print(f"{name}: {n}")
    for r in s.visible_roster():
        if r["kind"] == "column":
            checks = ", ".join(k for k, v in r["checks"].items() if v == "y")
            print(f"{r['name']}: {r['pending']} pending, top pair {r['top'][0]!r} → {r['top'][1]!r} {r['top_text']}" + f" [{checks}]" * bool(checks))
    for x in s.suggestions():
        print(f"{x.name_a!r} ~ {x.name_b!r} ({', '.join(x.why)}): {x.preview()}")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    n = parser().parse_args(args)
    try:
        spark = spark or SparkSession.builder.appName("exactdiff").getOrCreate()
        s = open_session(spark, n)
        code = 0
        while True:
            report(s)
            code = max(code, s.quit())
            if s.sheet + 1 >= len(s.sheets):
                return code
            s.next_sheet(confirmed=True)
            print(f"--- {s.sheets[s.sheet]}")
    except HardFail as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
