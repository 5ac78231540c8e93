"""Personal data: detection, detection through disguises, and masking.

Plain detection takes, for each kind, the leftmost non-overlapping matches of a pattern and drops those that fail a
test (parts of an address, digits and Luhn's sum of a card, digits of a phone number).

Disguises are undone by transducers, which rewrite a text and keep for each rewritten character the source characters
that it stands for. They compose in this order: look-alike letters and digits (whatever Unicode maps to one ASCII
character, the decimal digits of all scripts, and listed look-alikes of other scripts) become ASCII, invisible characters
go; HTML's names and numbers of @ and the full stop become these; `at` and `dot` in brackets, or as bare words in a chain
`name at host dot name`, become @ and a full stop; a bare `dot` between four or more numbers becomes a full stop. Then
runs of at least RUN digits, counted after undoing, become digits if some are spelled (in English, or in German, French
or Spanish) or `plus` begins them, and `plus` a plus sign: once with the separators as they stand, and once, if the run
has RUN groups or begins with `plus`, without them. The plain detectors run over each of the rewritten texts, and their
matches are mapped back to the source. A match is added if a disguise was undone inside it and no plain match of its
kind covers it wholly; one that is disguised in part is so added beside the plain match of its fragment. Plain matches
always stay.

A text without a sign of a disguise is not rewritten; signs are looked for in the whole text.

Defined cases: null text is empty; an empty table gives an empty result; spans are code points, end exclusive; repeated
rows are searched alike and keep their rows. detect() looks at doc_id and text only, whatever other columns are named;
redact() keeps all columns.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from exactdiff.llm.common import release

KINDS = ("email", "ip", "card", "phone")
#: The patterns of plain detection. Fixed values.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
#: The same matches in linear time: a match ends where a run of digits ends, so none begins inside a run.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_NOT_DIGIT = re.compile("[^0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, x in enumerate(reversed(digits)):
        d = int(x) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As EMAIL.finditer, but only around at signs."""
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and (c := text[begin - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            begin -= 1
        if begin < at and (m := EMAIL.match(text, begin)):
            end = m.end()
            yield begin, end
        at = text.find("@", max(end, at + 1))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


_FIND = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones}


def plain(text: str) -> list[Span]:
    """The plain matches, by start and then by kind as in KINDS."""
    found = [(kind, *span) for kind in KINDS for span in _FIND[kind](text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


#: Letters of other scripts that look like the ASCII letter beside them. Fixed values.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "ɑ": "a", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-",
}
#: Characters that show nothing. Fixed values.
INVISIBLE = "­​‌‍⁠﻿"


def _table() -> dict[str, str]:
    found = dict.fromkeys(INVISIBLE, "")
    for c in map(chr, [*range(0xA0, 0x3000), *range(0xFE50, 0xFFF0), *range(0x1D400, 0x1D800)]):
        x = unicodedata.normalize("NFKC", c)
        if len(x) == 1 and x.isascii() and x.isprintable() and not x.isspace() and unicodedata.category(c) not in ("No", "Lm"):
            found[c] = x
    digits = {c: str(d) for c in map(chr, range(0x80, sys.maxunicode + 1)) if (d := unicodedata.decimal(c, None)) is not None}
    return found | digits | LOOK_ALIKES


_ALIKE = _table()
_SIGN_ALIKE = re.compile("[" + "".join(map(re.escape, _ALIKE)) + "]")

#: Names of the digits: English ones, and German, French and Spanish ones. Fixed values.
ENGLISH = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
ABROAD = {
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "six": "6", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
RUN = 7
_PLUS = r"plus[ ,.(-]{1,3}"


class Digits:
    """Names of digits, and the transducers that undo them. letter: a class of what stands beside no name."""

    def __init__(self, names: dict[str, str], letter: str) -> None:
        self.names = names
        name = "(?:" + "|".join(sorted(names, key=len, reverse=True)) + ")"
        group = f"(?:[0-9]++|{name})(?!{letter})"
        run = rf"(?<!{letter})(?:%s%s|%s%s%s)(?:%s%s)*+"
        self.runs = {closed: re.compile(run % (_PLUS, group, group, by, group, by, group), re.I) for closed, by in ((False, "[ ,.()-]{1,4}"), (True, "[ ,.-]{1,3}"))}
        self.part = re.compile(rf"{_PLUS}|[0-9]+|{name}|[ ,.()-]+", re.I)
        number = rf"(?:[0-9]++|{name}(?:[ -]{{1,3}}{name}){{0,2}})(?!{letter})"
        self.chain = re.compile(rf"(?<!{letter}){number}(?:(?: {{1,3}}dot {{1,3}}|\.){number}){{3,}}", re.I)
        self.chain_part = re.compile(rf" {{1,3}}dot {{1,3}}|[ -]+|{name}", re.I)
        self.two = re.compile(rf"(?<!{letter}){name}[ ,.()-]{{1,4}}(?:{name}|[0-9])|[0-9][ ,.()-]{{1,4}}{name}(?!{letter})")

    def sign(self, low: str) -> bool:
        """Whether a text in lower case may have a run: a name beside another one or a digit."""
        return "plus" in low or self.two.search(low) is not None

    def dotted(self, text: str) -> Iterator[tuple[int, int, str]]:
        """Edits that make an address of numbers and names with a bare dot between them."""
        for m in self.chain.finditer(text):
            if not _LETTER.search(m[0]) or not re.search("[0-9]| dot ", m[0], re.I):
                continue
            for p in self.chain_part.finditer(m[0]):
                word = p[0].lower().strip(" ")
                yield m.start() + p.start(), m.start() + p.end(), "." if word == "dot" else self.names.get(word, "")

    def spelled(self, closed: bool):
        """Edits that make digits of runs; closed: without separators, of runs of RUN groups or behind a plus only."""

        def edits(text: str) -> Iterator[tuple[int, int, str]]:
            for m in self.runs[closed].finditer(text):
                if not _LETTER.search(m[0]):
                    continue
                parts = [(p.start(), p.end(), p[0].lower()) for p in self.part.finditer(m[0])]
                groups = [x for _, _, x in parts if x.isdigit() or x in self.names]
                if sum(len(x) if x.isdigit() else 1 for x in groups) < RUN:
                    continue
                if closed and len(groups) < RUN and not parts[0][2].startswith("plus"):
                    continue
                for a, b, word in parts:
                    by = "+" if word.startswith("plus") else self.names.get(word, "")
                    if by or closed and not word.isdigit():
                        yield m.start() + a, m.start() + b, by

        return edits


_LETTER = re.compile(r"[^\W\d_]")
SPOKEN = (Digits(ENGLISH, "[A-Za-z0-9]"), Digits(ABROAD, r"[^\W_]"))
_ENTITY_AT, _ENTITY_DOT = (re.compile(rf"&(?:#0{{0,5}}{n}|#x0{{0,5}}{n:x}|{name});", re.I) for n, name in ((64, "commat"), (46, "period")))
_AT_BOXED = re.compile(r"\s{0,3}[\[({<]\s{0,3}(?:at|@)\s{0,3}[\])}>]\s{0,3}", re.I)
_DOT_BOXED = re.compile(r"\s{0,3}[\[({<]\s{0,3}(?:dot|\.)\s{0,3}[\])}>]\s{0,3}", re.I)
_BARE = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?:(?: {1,3}at {1,3})|@)[A-Za-z0-9-]+(?:(?: {1,3}dot {1,3}|\.)[A-Za-z0-9-]+)+", re.I)
_BARE_PART = re.compile(r" {1,3}(at|dot) {1,3}", re.I)
_SIGN_BOX = re.compile(r"[\[({<]\s{0,3}(?:at|dot|@|\.)\s{0,3}[\])}>]", re.I)

#: A rewritten text: its characters, and for each the source's start and end and whether it was changed.
Tape = tuple[str, list[int], list[int], list[bool]]


def _rewrite(tape: Tape, edits: Iterator[tuple[int, int, str]]) -> Tape:
    """The tape with spans replaced; each new character stands for the whole span."""
    text, begin, end, new = tape
    out, b, e, n, last = [], [], [], [], 0
    for i, j, by in edits:
        out.append(text[last:i])
        b += begin[last:i]
        e += end[last:i]
        n += new[last:i]
        out.append(by)
        b += [begin[i]] * len(by)
        e += [end[j - 1]] * len(by)
        n += [True] * len(by)
        last = j
    if not last:
        return tape
    return "".join([*out, text[last:]]), b + begin[last:], e + end[last:], n + new[last:]


def _alike(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _SIGN_ALIKE.finditer(text):
        yield m.start(), m.end(), _ALIKE[m[0]]


def _boxed(pattern: re.Pattern, by: str):
    def edits(text: str) -> Iterator[tuple[int, int, str]]:
        for m in pattern.finditer(text):
            yield m.start(), m.end(), by

    return edits


def _bare(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _BARE.finditer(text):
        if " dot " in m[0].lower():
            for p in _BARE_PART.finditer(m[0]):
                yield m.start() + p.start(), m.start() + p.end(), "@" if p[1].lower() == "at" else "."


def disguised(text: str, known: list[Span]) -> list[Span]:
    """Matches that show only once disguises are undone, with places in the source; known: the plain matches."""
    alike = not text.isascii() and not _ALIKE.keys().isdisjoint(text)
    box = ("[" in text or "(" in text or "{" in text or "<" in text) and _SIGN_BOX.search(text) is not None
    entity = "&" in text and (_ENTITY_AT.search(text) or _ENTITY_DOT.search(text)) is not None
    low = text.lower() if not alike else ""
    named = [x for x in SPOKEN if alike or x.sign(low)]
    bare = alike or " dot " in low
    dotted = [x for x in SPOKEN if alike or box or (bare or x in named) and next(x.dotted(text), None) is not None]
    spelled = [x for x in named if alike or next(x.spelled(False)(text), None) is not None]
    if not (alike or box or entity or spelled or bare or dotted):
        return []
    tape: Tape = (text, list(range(len(text))), list(range(1, len(text) + 1)), [False] * len(text))
    if alike:
        tape = _rewrite(tape, _alike(tape[0]))
    if entity:
        tape = _rewrite(tape, _boxed(_ENTITY_AT, "@")(tape[0]))
        tape = _rewrite(tape, _boxed(_ENTITY_DOT, ".")(tape[0]))
    if alike or box:
        tape = _rewrite(tape, _boxed(_AT_BOXED, "@")(tape[0]))
        tape = _rewrite(tape, _boxed(_DOT_BOXED, ".")(tape[0]))
    if bare or box:
        tape = _rewrite(tape, _bare(tape[0]))
    for x in dotted:
        tape = _rewrite(tape, x.dotted(tape[0]))
    tapes = [tape, *(_rewrite(tape, x.spelled(closed)(tape[0])) for x in spelled for closed in (False, True))]
    whole = {k: sorted((a, b) for x, a, b in known if x == k) for k in KINDS}
    found = set()
    for rewritten, begins, ends, new in tapes:
        for kind, i, j in plain(rewritten):
            begin, end = begins[i], ends[j - 1]
            at = bisect_right(whole[kind], (begin, len(text) + 1)) - 1
            if (end - begin != j - i or any(new[i:j])) and not (at >= 0 and end <= whole[kind][at][1]):
                found.add((kind, begin, end))
    return _outermost(found)


def _outermost(found: set[Span]) -> list[Span]:
    """Those that lie in no other of their kind."""
    out: list[Span] = []
    for x in sorted(found, key=lambda x: (x[0], x[1], -x[2])):
        if not out or out[-1][0] != x[0] or x[2] > out[-1][2]:
            out.append(x)
    return out


def spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """The plain matches, and all matches, by start and then by kind."""
    base = plain(text or "")
    more = disguised(text or "", base)
    return base, sorted({*base, *more}, key=lambda x: (x[1], KINDS.index(x[0]), x[2])) if more else base


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id; n_email, n_ip, n_card, n_phone (plain matches); base (plain spans) and spans (all) as kind:start:end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            base, every = [], []
            for x in b.column(1):
                p, s = spans(x.as_py())
                for k in KINDS:
                    counts[k].append(sum(y[0] == k for y in p))
                base.append(joined(p))
                every.append(joined(s))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(base, pa.string()), pa.array(every, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def digest(found: DataFrame) -> DataFrame:
    """detect()'s rows with base as a SHA-256 digest."""
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")


def mask(text: str) -> str:
    """The text with each match, overlapping ones together, replaced by its kind in square brackets."""
    out, last = [], 0
    for kind, a, b in spans(text)[1]:
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]]) if out else text


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the texts masked; null texts stay null and all other columns as they are."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([None if (t := x.as_py()) is None else mask(t) for x in b.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(b.columns)], schema=pa.schema([pa.field(f.name, pa.string()) if i == at else f for i, f in enumerate(b.schema)]))
            release()

    schema = StructType([StructField(f.name, StringType()) if i == at else f for i, f in enumerate(docs.schema.fields)])
    return docs.mapInArrow(run, schema)
