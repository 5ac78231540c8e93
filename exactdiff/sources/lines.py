"""Strict delimited text from folders and from any store that Spark reads: many files, each in ranges.

Spark's text source cuts the files at its own ranges and gives each task raw lines; no file is opened by its path, so
HDFS, object stores and folders of part files are all alike. What a quote means depends on all lines before it, as in
`delimited`: one pass finds for every range whether it ends inside quotes if it begins outside, and if it begins inside.
These two bits a range are chained file by file on the driver. In the second pass every range parses the records that
begin in it. The lines in front of its first record, and those of a last record that goes on behind it, come out as
pieces; the pieces of one record, which name the range that it begins in, are put together and parsed by themselves.
A task takes several ranges, of about TASK bytes, so that the number of tasks doesn't grow with small ranges.

Every file must begin with the same header, which must end in the file's first range. Blank lines are skipped, short rows are padded, and everything else fails, as
in `delimited`. Lines end with \\n or \\r\\n; a file that uses \\r alone is read as one record and so fails or shows it.
"""

from __future__ import annotations

import csv
import sys
import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exactdiff.errors import HardFail
from exactdiff.lineage import folder
from exactdiff.sources.delimited import RANGE, _BOM, _behind, renamed
from exactdiff.sources.options import ENCODINGS

_ROWS = 10_000
#: Bytes of a task's ranges together, about, beside one range.
TASK = 1 << 25


def _lines(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    """raw, file, start: the lines of all files without their \\n, each range's in order, and the range that each is of."""
    read = spark.read.option("lineSep", "\n").text(path)
    ranges = read.rdd.getNumPartitions()
    read = read.coalesce(min(ranges, max(2 * spark.sparkContext.defaultParallelism, -(-ranges * range_bytes // TASK))) or 1)
    return read.select(F.col("value").cast("binary").alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int] | None, bytes]]:
    """Lines with their range where it changes, else with None."""
    at = None
    for b in batches:
        raws, files, starts = b.column(0).to_pylist(), b.column(1).dictionary_encode(), b.column(2).to_numpy()
        file = files.indices.to_numpy()
        # a batch holds lines of few ranges
        edges = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (starts[1:] != starts[:-1])) + 1).tolist(), len(raws)]
        for lo, hi in zip(edges[: len(raws)], edges[1:]):
            new = (files.dictionary[int(file[lo])].as_py(), int(starts[lo]))
            for raw in raws[lo:hi]:
                yield (new if new != at else None), raw
                at = new


def _parsed(lines: list[bytes], codec: str, errors: str, delimiter: str) -> list[list[str]]:
    csv.field_size_limit(sys.maxsize)
    return list(csv.reader((x.decode(codec, errors) for x in lines), delimiter=delimiter, strict=True))


def _begin(raw: bytes, at: tuple[str, int], codec: str) -> bytes:
    return raw.removeprefix(_BOM) if at[1] == 0 and codec == "utf-8" else raw


def _first_pass(lines: DataFrame, codec: str, errors: str, delimiter: str) -> DataFrame:
    """Of each range its two bits, and of a file's first range the header, if it ends there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        at, inside, head, open_header = None, (False, True), [], False

        def close() -> None:
            if at is not None:
                names = _parsed(head, codec, errors, delimiter) if head and not open_header else []
                out.append((*at, *inside, names[0] if names else None))

        for new, raw in _ranges(batches):
            line = raw + b"\n"
            if new is not None:
                close()
                at, inside, head, open_header = new, (False, True), [], new[1] == 0
                line = _begin(line, new, codec)
            if b'"' in line:
                inside = _behind(line, inside, b"\n", delimiter)
            if open_header and (head or line.strip(b"\r\n")):
                head.append(line)
                open_header = inside[0]
        close()
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.string())]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["file", "start", "outside", "inside", "header"])

    return lines.mapInArrow(run, "file string, start long, outside boolean, inside boolean, header array<string>")


def _split(raw: bytes) -> list[bytes]:
    """The lines of a piece, whose last one ends like the others."""
    return [x + b"\n" for x in raw[:-1].split(b"\n")]


def read(spark: SparkSession, path: str, encoding: str, delimiter: str, range_bytes: int = RANGE) -> tuple[list[str], DataFrame]:
    """The headers, and a frame of texts with columns c0, c1, ... in their order, which has been written once below the
    checkpoint folder."""
    codec, errors = ENCODINGS[encoding]
    ranged = spark.newSession()  # a session of its own, so that the size of ranges holds for this reading only
    for name in ("maxPartitionBytes", "openCostInBytes"):
        ranged.conf.set(f"spark.sql.files.{name}", str(range_bytes))
    lines = _lines(ranged, path, range_bytes)
    found = _first_pass(lines, codec, errors, delimiter).cache()
    try:
        # a row of two bits and a place for each range
        states = found.select("file", "start", "outside", "inside").collect()
        files = len({r.file for r in states})
        heads = found.where("header is not null").groupBy("header").count().limit(3).collect()
    finally:
        found.unpersist()
    if not heads:
        raise HardFail(f"{path} has no header row")
    if len(heads) > 1 or heads[0]["count"] != files:
        raise HardFail(f"the files of {path} don't begin with one and the same header")
    headers = renamed(heads[0].header)
    width = len(headers)
    chain: dict[tuple[str, int], bool] = {}
    for file, some in groupby(sorted(states, key=lambda r: (r.file, r.start)), key=lambda r: r.file):
        inside = False
        for r in some:
            chain[file, r.start] = inside
            inside = r.inside if inside else r.outside
        if inside:
            raise HardFail(f"a quote in {file} is never closed")
    shared = spark.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list[str]] = []
        pieces: list[tuple] = []
        block: list[bytes] = []
        at, inside, first_open, skip = None, False, False, False
        held: list[bytes] = []

        def flush() -> None:
            nonlocal skip
            for record in _parsed(block, codec, errors, delimiter):
                if not record:
                    continue
                if skip:
                    skip = False
                    continue
                if len(record) > width:
                    raise ValueError(f"a row has {len(record)} fields, the header {width}")
                rows.append(record + [""] * (width - len(record)))
            block.clear()

        def close() -> None:
            """The end of a range: whole records are parsed; what is still open is a piece that begins a record, or, if no
            record began in the range, one that goes on with another's."""
            flush()
            if held:
                pieces.append((*at, not first_open, b"".join(held)))
                held.clear()

        def batch() -> pa.RecordBatch:
            n, m = len(rows), len(pieces)
            fields = pa.array([*rows, *[None] * m], pa.list_(pa.string()))
            columns = [[*[None] * n, *x] for x in zip(*pieces)] if pieces else [[None] * n] * 4
            out = pa.RecordBatch.from_arrays([fields, *(pa.array(x, k) for x, k in zip(columns, [pa.string(), pa.int64(), pa.bool_(), pa.binary()]))], names=["fields", "file", "start", "begins", "raw"])
            rows.clear()
            pieces.clear()
            return out

        for new, raw in _ranges(batches):
            line = raw + b"\n"
            if new is not None:
                if at is not None:
                    close()
                at, inside = new, shared.value[new]
                first_open, skip = inside, new[1] == 0
                line = _begin(line, new, codec)
            held.append(line)
            if b'"' in line:
                (inside,) = _behind(line, (inside,), b"\n", delimiter)
            if inside:
                continue
            if first_open:
                # the end of a record that began in an earlier range
                pieces.append((*at, False, b"".join(held)))
                first_open = False
            else:
                block += held
            held.clear()
            if len(block) + len(rows) >= _ROWS:
                flush()
                yield batch()
        if at is not None:
            close()
            yield batch()

    where = f"{folder(spark)}/lines-{uuid.uuid4().hex}"
    lines.mapInArrow(run, "fields array<string>, file string, start long, begins boolean, raw binary").write.parquet(where)
    both = spark.read.parquet(where)
    whole = both.where("fields is not null").select("fields")
    # a record's pieces: its beginning in one range, whole ranges inside quotes, and its end in another; two a range at most
    pieces = both.where("raw is not null").select("file", "start", "begins", "raw")
    owner, owners = None, []
    for file, start, begins in sorted(map(tuple, pieces.select("file", "start", "begins").collect())):
        owner = (file, start) if begins else owner
        owners.append((file, start, begins, *owner))
    columns = [F.col("fields")[i].alias(f"c{i}") for i in range(width)]
    if not owners:
        return headers, whole.select(*columns)
    owned = spark.createDataFrame(owners, "file string, start long, begins boolean, owner string, place long")

    def join(table: pa.Table) -> pa.Table:
        parts = sorted(zip(table.column("start").to_pylist(), (not x for x in table.column("begins").to_pylist()), table.column("raw").to_pylist()))
        (record,) = _parsed(_split(b"".join(raw for _, _, raw in parts)), codec, errors, delimiter)
        if len(record) > width:
            raise ValueError(f"a row has {len(record)} fields, the header {width}")
        return pa.table({"fields": pa.array([record + [""] * (width - len(record))], pa.list_(pa.string()))})

    stitched = pieces.join(F.broadcast(owned), ["file", "start", "begins"]).groupBy("owner", "place").applyInArrow(join, "fields array<string>")
    return headers, whole.unionByName(stitched).select(*columns)
