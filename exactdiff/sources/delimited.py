"""A strict reader of delimited text: `spark.read.format("strict_delimited")`.

Every deviation fails: bytes that the encoding can't decode (unless a lossy one was asked for), a row with more fields
than the header, an unclosed quote, text behind a closing quote. Short rows are padded with empty texts, blank lines are
skipped, nothing is inferred.

A file is read in ranges of RANGE bytes by as many tasks. Whether a range begins inside quotes depends on all before it: a
quote opens a field only where one begins, so a quote in the middle of a plain field is text and counts for nothing. One
job finds for every range where it ends up if it begins outside quotes and if it begins inside; chaining these answers, two
bits a range, gives each range its beginning. A task starts behind the first line break outside quotes and finishes the
record that it is in.
"""

from __future__ import annotations

import csv
import os
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from exactdiff.errors import HardFail
from exactdiff.sources.options import ENCODINGS

RANGE = 64 << 20
_ROWS = 10_000
_BLOCK = 4 << 20
_BOM = b"\xef\xbb\xbf"


_QUOTES = re.compile(b'"+')


class Range(InputPartition):
    """Records that begin in bytes [begin, end) of the file; inside: whether byte begin lies inside quotes, where a run
    of quotes that began before it counts as read."""

    def __init__(self, begin: int, end: int, inside: bool) -> None:
        self.begin, self.end, self.inside = begin, end, inside


def _opens(before: bytes, delimiter: str) -> bool:
    """Whether a field begins behind a byte (none: the file begins)."""
    return before in (b"", b"\n", b"\r", delimiter.encode())


def _behind(data: bytes, inside: tuple[bool, ...], before: bytes, delimiter: str) -> tuple[bool, ...]:
    """Whether one is inside quotes behind data, for each way to begin. before: the byte in front of data; if it is a
    quote, the run of quotes that it belongs to has been read."""
    at = len(_QUOTES.match(data)[0]) if before == b'"' and data[:1] == b'"' else 0
    for m in _QUOTES.finditer(data, at):
        even, opens = len(m[0]) % 2 == 0, _opens(data[m.start() - 1 : m.start()] if m.start() else before, delimiter)
        inside = tuple(even if x else opens and not even for x in inside)
    return inside


def _first(path: str, codec: str, begin: int) -> tuple[int, bytes]:
    """Where text begins in a range, behind a mark of byte order if it is the first, and the byte before that."""
    with open(path, "rb") as f:
        f.seek(max(begin - 1, 0))
        head = f.read(3)
    if not begin:
        return (3 if codec == "utf-8" and head == _BOM else 0), b""
    return begin, head[:1]


def _ends(path: str, codec: str, delimiter: str, begin: int, end: int) -> tuple[bool, ...]:
    """Whether a range ends inside quotes if it begins outside, and if it begins inside; it ends behind a run of quotes."""
    at, before = _first(path, codec, begin)
    inside = (False, True)
    with open(path, "rb") as f:
        f.seek(at)
        while at < end:
            data = f.read(min(_BLOCK, end - at))
            if not data:
                break
            while data[-1:] == b'"' and (more := f.read(1)):
                data += more
            inside, before, at = _behind(data, inside, before, delimiter), data[-1:], at + len(data)
    return inside


def beginnings(spark: SparkSession, path: str, encoding: str, delimiter: str) -> str:
    """Of each range of a file, 1 if it begins inside quotes, else 0."""
    codec, size, each = ENCODINGS[encoding][0], os.path.getsize(path), RANGE
    n = max(1, -(-size // each))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            found = [_ends(path, codec, delimiter, i * each, min((i + 1) * each, size)) for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([x[k] for x in found], pa.bool_()) for k in (0, 1))], names=["id", "outside", "inside"])

    # a row of two bits for each 64 MB of the file; the last range's end is of no interest
    found = sorted(map(tuple, spark.range(0, n - 1, 1, n - 1).mapInArrow(run, "id long, outside boolean, inside boolean").collect())) if n > 1 else []
    out = [False]
    for _, outside, inside in found:
        out.append(inside if out[-1] else outside)
    return "".join("01"[x] for x in out)


def _records(path: str, codec: str, errors: str, delimiter: str, part: Range) -> Iterator[list[str]]:
    csv.field_size_limit(sys.maxsize)
    with open(path, "rb") as f:
        at, before = _first(path, codec, part.begin)
        f.seek(at)
        if part.begin and (part.inside or before != b"\n"):
            inside = (part.inside,)
            for raw in f:
                inside, before, at = _behind(raw, inside, before, delimiter), raw[-1:], at + len(raw)
                if not inside[0]:
                    break

        def lines() -> Iterator[str]:
            nonlocal at
            for raw in f:
                at += len(raw)
                yield raw.decode(codec, errors)

        reader = csv.reader(lines(), delimiter=delimiter, strict=True)
        while at < part.end:
            record = next(reader, None)
            if record is None:
                return
            yield record


def renamed(record: list[str]) -> list[str]:
    """Headers of which a later copy has _duplicated_0 and so on behind it."""
    names: list[str] = []
    for x in record:
        k, name = 0, x
        while name in names:
            name, k = f"{x}_duplicated_{k}", k + 1
        names.append(name)
    return names


def read_header(path: str, encoding: str, delimiter: str) -> list[str]:
    """The first record, as renamed()."""
    codec, errors = ENCODINGS[encoding]
    for record in _records(path, codec, errors, delimiter, Range(0, sys.maxsize, False)):
        if record:
            return renamed(record)
    raise HardFail(f"{path} has no header row")


class StrictReader(DataSourceReader):
    def __init__(self, options: dict[str, str], width: int) -> None:
        self.path, self.delimiter, self.width = options["path"], options["delimiter"], width
        self.codec, self.errors = ENCODINGS[options["encoding"]]
        self.inside, self.range = options["inside"], int(options["range"])

    def partitions(self) -> list[Range]:
        size = os.path.getsize(self.path)
        return [Range(i * self.range, min((i + 1) * self.range, size), x == "1") for i, x in enumerate(self.inside)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows: list[list[str]] = []
        names = [f"c{i}" for i in range(self.width)]
        header = partition.begin == 0

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows)], names=names)
            rows.clear()
            return out

        for record in _records(self.path, self.codec, self.errors, self.delimiter, partition):
            if not record:
                continue
            if header:
                header = False
                continue
            if len(record) > self.width:
                raise ValueError(f"a row has {len(record)} fields, the header {self.width}")
            rows.append(record + [""] * (self.width - len(record)))
            if len(rows) == _ROWS:
                yield batch()
        if rows:
            yield batch()


class StrictDelimited(DataSource):
    """Options: path, delimiter (a character), encoding (one of options.ENCODINGS), range (bytes), inside (beginnings() of
    ranges of that size). Columns are named c0, c1, ..."""

    @classmethod
    def name(cls) -> str:
        return "strict_delimited"

    def schema(self) -> str:
        return ", ".join(f"c{i} string" for i in range(len(read_header(self.options["path"], self.options["encoding"], self.options["delimiter"]))))

    def reader(self, schema) -> StrictReader:
        return StrictReader(dict(self.options), len(schema.fields))


def read(spark: SparkSession, path: str, encoding: str, delimiter: str) -> tuple[list[str], DataFrame]:
    """The headers, and a frame of texts with columns c0, c1, ... in their order."""
    spark.dataSource.register(StrictDelimited)
    headers = read_header(path, encoding, delimiter)
    return headers, spark.read.format("strict_delimited").options(path=path, encoding=encoding, delimiter=delimiter, range=RANGE, inside=beginnings(spark, path, encoding, delimiter)).load()
