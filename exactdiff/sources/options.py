"""Options of sources as they are written on a command line."""

from __future__ import annotations

import re
from pathlib import Path

from exactdiff.errors import HardFail

#: Delimiters and their names. Fixed values.
DELIMITERS = {"comma": ",", "tilde": "~", "pipe": "|", "tab": "\t"}
#: Encodings by their option: Python's codec and what it does with bytes that it can't decode. Fixed values.
ENCODINGS = {"utf8": ("utf-8", "strict"), "windows-1252": ("cp1252", "strict"), "utf8-lossy": ("utf-8", "replace"), "windows-1252-lossy": ("cp1252", "replace")}


def delimiter(raw: str, flag: str) -> str:
    name = raw if raw in DELIMITERS.values() else raw.strip().lower()
    found = DELIMITERS.get(name) or {"\\t": "\t", **{c: c for c in DELIMITERS.values()}}.get(name)
    if found is None:
        raise HardFail(f"{flag} can't be {raw!r}: name a delimiter ({', '.join(DELIMITERS)}) or write the character itself, a tab also as \\t")
    return found


def encoding(raw: str, flag: str) -> str:
    name = raw.strip().lower()
    if name not in ENCODINGS:
        raise HardFail(f"{flag} can't be {raw!r}: the encodings are {', '.join(ENCODINGS)}")
    return name


def keys(raw: str) -> list[str]:
    """Column names between commas, stripped, in order; each once and none empty."""
    names = [x.strip() for x in raw.split(",")]
    if not any(names):
        raise HardFail("--keys names no column")
    if "" in names:
        raise HardFail("--keys has nothing between two commas or at an end")
    for i, x in enumerate(names):
        if x in names[:i]:
            raise HardFail(f"--keys names {x!r} twice")
    return names


def is_workbook(path: str) -> bool:
    return Path(path).suffix.lower() in (".xlsx", ".xlsm")


def is_remote(path: str) -> bool:
    """Whether a path names the store that it is in, as hdfs://... does."""
    return re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path) is not None


def absolute(path: str) -> str:
    return path if is_remote(path) else str(Path(path).expanduser().resolve())


_SPAN = re.compile(r"(-?\d+)(?:-(-?\d+))?")


def sheets(raw: str, flag: str = "--sheets") -> list[str]:
    """A set of sheets: `data{1-4,7}` for data1 to data4 and data7, or names between commas; in the order written."""

    def bad(why: str) -> HardFail:
        return HardFail(f"{flag} {raw!r}: {why}")

    text = (raw or "").strip()
    if not text:
        raise HardFail(f"{flag} names no sheet")
    prefix, inner = "", text
    if "{" in text or "}" in text:
        whole = re.fullmatch(r"([^{}]*)\{([^{}]*)\}", text, re.S)
        if whole is None:
            raise bad("one pair of braces may stand, at the end")
        prefix, inner = whole.groups()
    items = [x.strip() for x in inner.split(",")]
    if "" in items:
        raise bad("nothing stands between two commas or at an end")
    names = items
    if inner is not text:
        names = []
        for item in items:
            span = _SPAN.fullmatch(item)
            if span is None:
                raise bad(f"{item!r} is neither a number nor a span of numbers; names go without braces")
            first, last = int(span[1]), int(span[2] or span[1])
            if first > last:
                raise bad(f"the span {item!r} runs backwards")
            names += [f"{prefix}{n}" for n in range(first, last + 1)]
    for i, x in enumerate(names):
        if x in names[:i]:
            raise bad(f"{x!r} comes up twice")
    return names
