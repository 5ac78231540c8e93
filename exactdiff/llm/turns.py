"""Conversation structure repair: the cheapest edits that make a conversation's roles follow a grammar.

Roles by their initials must read `(s?(ua)+)?`. A row is kept (K, cost 0), given the role that the grammar wants there,
user or assistant (R, 1), or deleted (D, 2); a row with an empty text may be inserted anywhere (I, 5). Blank rows and
rows whose role and text the conversation has had before must be deleted; a row that ends in the middle of a sentence
costs 5 more unless it is deleted. Of the cheapest edit sequences the one with the ASCII-least letters is taken.

The grammar has four states (nothing, s, u, a), each of which wants one role next, so a sequence of letters fixes all
roles. What a stretch of rows does is a table: for each state before and each after it, the least cost and its letters.
Equally cheap letters for the same rows and states are never one the beginning of the other (that would take rows
inserted for nothing), so least tables of neighbouring stretches compose. Rows are put into one order over all
conversations, numbered, and cut into segments of SEGMENT rows of a conversation. Segments are hashed to partitions, and
batches of whole segments go through one recursive DuckDB query each: every step advances all segments of the batch by
one row and keeps least cost and letters for each state. Further levels do the same with SEGMENT tables for a row, until
each conversation is one table; so a conversation of any length, even one with a third of all rows, is the work of many
tasks, and no batch holds more than BATCH rows and a segment. The texts don't take part: a row is its digest, its
initial and its faults. Rows that are equal throughout are one row with a count until the texts are repaired.

At last texts, ordered in partitions of whole conversations, meet their letters, which go through them once; only here
does a conversation belong to one task, which reads it as a stream, since a digest of its whole text can't be had
otherwise.

Defined cases: a null role or text is one space, so such a text is blank; rows are ordered by turn, null first, and rows
that share a turn by the digest of role and text, so equal rows are neighbours; a null conv_id names one conversation;
a conversation without rows needs no edits; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exactdiff.llm.common import cut

SEGMENT, BATCH = 256, 16_384
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: What each state wants next: (the initial it reads, the state then); states are 0 nothing, 1 s, 2 u, 3 a.
NEXT = {0: (("s", 1), ("u", 2)), 1: (("u", 2),), 2: (("a", 3),), 3: (("u", 2),)}
#: The role that a given or inserted row gets, and the state then.
GIVEN = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
#: The letters that end a conversation from each state, with their cost.
CLOSING = {0: (0, ""), 1: (2 * INSERT, "II"), 2: (INSERT, "I"), 3: (0, "")}
LEGAL = ("su", "ua", "au")
_KEY = ["named", "id"]
BLANK, LAST = r"[^\x20\x09-\x0D]", r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\z)"


def _inserted(state: int) -> list[tuple[int, int, str]]:
    """State, cost and letters after no, one or two insertions; more come back to a state that was cheaper before."""
    found = {state: (0, "")}
    for n in (1, 2):
        state = GIVEN[state][1]
        found.setdefault(state, (n * INSERT, "I" * n))
    return [(s, *x) for s, x in found.items()]


def edits() -> list[tuple[int, int, str | None, int, str, bool]]:
    """State before, state after, the initial that the row must have (or None), cost, letters, whether the row stays."""
    out = []
    for before in NEXT:
        for state, cost, letters in _inserted(before):
            out.append((before, state, None, cost + DELETE, letters + "D", False))
            out += [(before, after, initial, cost + KEEP, letters + "K", True) for initial, after in NEXT[state]]
            out.append((before, GIVEN[state][1], None, cost + REROLE, letters + "R", True))
    return out


def damage(conversations: DataFrame) -> DataFrame:
    """The rows of conversations with faults put in by a hash of conv_id and turn: named, id, turn, role, text, copies
    (0 where a row is dropped). Nulls read as one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    role = F.when(fault == 4, "user").otherwise(shown("role"))
    copies = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    return _rows(conversations, role, text, copies)


def _rows(conversations: DataFrame, role: Column, text: Column, copies: Column) -> DataFrame:
    return conversations.select(F.col("conv_id").isNotNull().alias("named"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.cast("long").alias("copies"))


def plain(conversations: DataFrame) -> DataFrame:
    """The rows of conversations as they are, in the form of damage()."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return _rows(conversations, shown("role"), shown("text"), F.lit(1))


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def _turn() -> list[Column]:
    """The turn as two columns that sort with null first and never are null."""
    return [F.col("turn").isNotNull().alias("dated"), F.coalesce("turn", F.lit(0)).alias("turn")]


def faults(rows: DataFrame) -> DataFrame:
    """named, id, dated, turn, digest, n (equal rows), initial, blank, again (all n were seen before), truncated: one
    row for each set of equal rows."""
    last = F.regexp_extract("text", LAST, 0)
    facts = rows.where("copies > 0").select(*_KEY, *_turn(), _digest().alias("digest"), "copies", F.substring("role", 1, 1).alias("initial"), (~F.col("text").rlike(BLANK)).alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"))
    each = facts.groupBy(*_KEY, "dated", "turn", "digest").agg(F.sum("copies").alias("n"), *(F.first(c).alias(c) for c in ("initial", "blank", "truncated")))
    first = each.groupBy(*_KEY, "digest").agg(F.min(F.struct("dated", "turn")).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    later = F.coalesce(F.struct("dated", "turn") > F.col("first"), F.lit(False))
    # the join's keys repeat on the left side only, which adaptive execution splits where one of them is hot
    return each.join(first, [*_KEY, "digest"], "left").withColumn("again", later & ~F.col("blank")).drop("first")


def placed(found: DataFrame) -> DataFrame:
    """The rows of faults() with place: their number in the order of conversation, turn and digest over all tasks."""
    order = [*_KEY, "dated", "turn", "digest"]
    sorted_rows = cut(found.repartitionByRange(*order).sortWithinPartitions(*order).drop("digest").withColumn("at", F.monotonically_increasing_id()))
    # a number for each partition, not for each row
    sizes = sorted(sorted_rows.groupBy(F.shiftright("at", 33).alias("part")).count().collect())
    start, n = {}, 0
    for part, size in sizes:
        start[part], n = n, n + size
    starts = sorted_rows.sparkSession.createDataFrame(list(start.items()), "part long, start long")
    inside = F.col("at").bitwiseAND((1 << 33) - 1)
    return sorted_rows.join(F.broadcast(starts), F.shiftright("at", 33) == F.col("part")).withColumn("place", F.col("start") + inside).drop("at", "part", "start")


#: What is known of a stretch of rows of one conversation: its first and last initial, its pairs of neighbours that the
#: grammar forbids, and a table of the states before and after it with the least cost and its letters.
TABLE = "named boolean, id long, segment long, first string, last string, illegal long, before array<int>, after array<int>, cost array<long>, letters array<string>"
_NAMES = ["named", "id", "segment", "first", "last", "illegal", "before", "after", "cost", "letters"]

_ILLEGAL = f"coalesce(lag(last) OVER (PARTITION BY seg ORDER BY i) || first NOT IN {LEGAL}, false)"
_WALK = """
WITH RECURSIVE moves AS MATERIALIZED ({moves}),
walk(seg, before, state, i, cost, letters) USING KEY (seg, before, state) AS (
  SELECT seg, s, s, CAST(0 AS BIGINT), CAST(0 AS BIGINT), '' FROM (SELECT DISTINCT seg FROM items), range(4) t(s)
  UNION
  SELECT seg, before, after, i, least_of.cost, least_of.letters FROM (
    SELECT w.seg, w.before, m.after, m.i, min({{'cost': w.cost + m.cost, 'letters': w.letters || m.letters}}) AS least_of
    FROM walk w JOIN moves m ON m.seg = w.seg AND m.i = w.i + 1 AND m.before = w.state
    GROUP BY ALL
  )
),
tables AS (SELECT seg, list(before ORDER BY before, state) AS before, list(state ORDER BY before, state) AS after, list(cost ORDER BY before, state) AS cost, list(letters ORDER BY before, state) AS letters FROM walk GROUP BY seg),
marked AS (SELECT seg, i, first, last, illegal + CAST({illegal} AS BIGINT) AS illegal FROM items)
SELECT seg, min_by(first, i) AS first, max_by(last, i) AS last, CAST(sum(illegal) AS BIGINT) AS illegal, any_value(before) AS before, any_value(after) AS after, any_value(cost) AS cost, any_value(letters) AS letters
FROM marked JOIN tables USING (seg) GROUP BY seg ORDER BY seg
"""
#: Moves over one row: n equal rows, of which the first may stay unless it must go and the others go.
_ROW_MOVES = f"""
SELECT seg, i, e.before, e.after, CAST(e.cost + CASE WHEN e.stays AND truncated THEN {TRUNCATED} ELSE 0 END + {DELETE} * (n - 1) AS BIGINT) AS cost, e.letters || repeat('D', CAST(n - 1 AS INTEGER)) AS letters
FROM items JOIN edits e ON (e.initial IS NULL OR e.initial = first) AND NOT (e.stays AND must_go)
"""
#: Moves over one stretch.
_TABLE_MOVES = "SELECT seg, i, unnest(before) AS before, unnest(after) AS after, unnest(cost) AS cost, unnest(letters) AS letters FROM items"


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """BATCH rows or some more, so that no segment is divided; rows come ordered by segment."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        for lo in range(0, len(b), BATCH):
            held.append(b.slice(lo, BATCH))
            n += len(held[-1])
            if n < BATCH:
                continue
            whole = pa.Table.from_batches(held)
            key = lambda r: tuple(whole.column(c)[r].as_py() for c in ("named", "id", "segment"))  # noqa: E731, B023
            last, end = key(n - 1), n - 1
            while end and key(end - 1) == last:
                end -= 1
            if end:
                yield whole.slice(0, end)
                held, n = whole.slice(end).to_batches(), n - end
    if n:
        yield pa.Table.from_batches(held)


def _walked(items: DataFrame, moves: str) -> DataFrame:
    """One TABLE row for each segment of items, which have named, id, segment, place, first, last, illegal and what the
    moves need."""
    query = _WALK.format(moves=moves, illegal=_ILLEGAL)
    steps = edits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""}) as db:
            db.execute("CREATE TABLE edits(before INTEGER, after INTEGER, initial VARCHAR, cost BIGINT, letters VARCHAR, stays BOOLEAN)")
            db.executemany("INSERT INTO edits VALUES (?, ?, ?, ?, ?, ?)", steps)
            for some in _batches(batches):
                db.register("given", some)
                db.execute("CREATE OR REPLACE TEMP TABLE items AS SELECT *, dense_rank() OVER (ORDER BY named, id, segment) AS seg, row_number() OVER (PARTITION BY named, id, segment ORDER BY place) AS i FROM given")
                out = db.sql(f"SELECT named, id, segment, w.first, w.last, w.illegal, w.before, w.after, w.cost, w.letters FROM ({query}) w JOIN (SELECT DISTINCT seg, named, id, segment FROM items) USING (seg)").to_arrow_table()
                db.unregister("given")
                kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string())]
                yield from out.cast(pa.schema(list(zip(_NAMES, kinds)))).to_batches()

    order = [*_KEY, "segment", "place"]
    return items.repartition(*_KEY, "segment").sortWithinPartitions(*order).mapInArrow(run, TABLE)


def tables(rows: DataFrame) -> DataFrame:
    """The TABLE of each conversation that has rows, from placed()."""
    items = rows.select(*_KEY, F.floor(F.col("place") / SEGMENT).cast("long").alias("segment"), "place", F.col("initial").alias("first"), F.col("initial").alias("last"), (F.col("n") - 1).alias("illegal"), "n", (F.col("blank") | F.col("again")).alias("must_go"), "truncated")
    found = cut(_walked(items, _ROW_MOVES))
    level = 0
    while not found.groupBy(*_KEY).count().where("count > 1").isEmpty():
        level += 1
        # every other level cuts in the middle of the others' stretches, so that neighbours across a border meet
        shift = SEGMENT // 2 * (level % 2)
        upper = found.withColumn("place", F.col("segment")).withColumn("segment", F.floor((F.col("place") + shift) / SEGMENT).cast("long"))
        found = cut(_walked(upper, _TABLE_MOVES))
    return found


def audits(found: DataFrame) -> DataFrame:
    """named, id, illegal, cost, audit of each conversation from its table."""
    closing = F.array(*(F.struct(F.lit(CLOSING[s][0]).cast("long").alias("cost"), F.lit(CLOSING[s][1]).alias("letters")) for s in range(4)))
    ways = F.filter(F.arrays_zip("before", "after", "cost", "letters"), lambda x: x["before"] == 0)
    ended = F.transform(ways, lambda x: F.struct((x["cost"] + closing[x["after"]]["cost"]).alias("cost"), F.concat(x["letters"], closing[x["after"]]["letters"]).alias("letters")))
    return found.select(*_KEY, "illegal", F.array_min(ended).alias("x")).select(*_KEY, "illegal", "x.cost", F.col("x.letters").alias("audit"))


REPAIRED = "named boolean, id long, place long, edit string, role string, text string"


def repaired(rows: DataFrame, letters: DataFrame) -> DataFrame:
    """The rows after repair, in partitions of whole conversations and in order: place (from 0; deleted rows have none),
    edit, role, text. A conversation without rows left has one row of nulls."""
    texts = rows.where("copies > 0").select(*_KEY, F.lit(True).alias("is_row"), *_turn(), _digest().alias("digest"), "role", "text", "copies", F.lit(None).cast("string").alias("audit"))
    heads = letters.select(*_KEY, F.lit(False).alias("is_row"), F.lit(False).alias("dated"), F.lit(0).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("copies"), "audit")
    order = [*_KEY, "is_row", "dated", "turn", "digest"]
    dealt = texts.unionByName(heads).repartition(*_KEY).sortWithinPartitions(*order).select(*_KEY, "is_row", "role", "text", "copies", "audit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        key, audit, at, state, place = None, "", 0, 0, 0

        def put(edit: str, role: str, text: str) -> None:
            nonlocal place, size
            out.append((*key, place, edit, role, text))
            place, size = place + 1, size + len(text)

        def insert() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                role, state = GIVEN[state]
                put("I", role, "")
                at += 1

        def end() -> None:
            if key is not None:
                insert()
                if not place:
                    out.append((*key, None, None, None, None))

        def batch() -> pa.RecordBatch:
            nonlocal size
            kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            made = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["named", "id", "place", "edit", "role", "text"])
            out.clear()
            size = 0
            return made

        for b in batches:
            for named, number, is_row, role, text, copies, letters in zip(*(c.to_pylist() for c in b.columns)):
                if not is_row:
                    end()
                    key, audit, at, state, place = (named, number), letters, 0, 0, 0
                    continue
                for _ in range(copies):
                    insert()
                    edit = audit[at]
                    at += 1
                    if edit == "K":
                        state = dict(NEXT[state])[role[:1]]
                        put("K", role, text)
                    elif edit == "R":
                        given, state = GIVEN[state]
                        put("R", given, text)
                if size > 1 << 22 or len(out) > 10_000:
                    yield batch()
        end()
        if out:
            yield batch()

    return dealt.mapInArrow(run, REPAIRED)


def digests(fixed: DataFrame) -> DataFrame:
    """named, id, repaired_sha256 of repaired() rows, which each task reads as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hasher, out = None, None, []
        for b in batches:
            for named, number, place, role, text in zip(*(b.column(c).to_pylist() for c in ("named", "id", "place", "role", "text"))):
                if key != (named, number):
                    if key is not None:
                        out.append((*key, hasher.hexdigest()))
                    key, hasher = (named, number), hashlib.sha256()
                if place is not None:
                    hasher.update((("\n" if place else "") + f"{role}:{text}").encode())
            if len(out) > 10_000:
                yield made(out)
                out = []
        if key is not None:
            out.append((*key, hasher.hexdigest()))
        if out:
            yield made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), [pa.bool_(), pa.int64(), pa.string()])], names=["named", "id", "repaired_sha256"])

    return fixed.mapInArrow(run, "named boolean, id long, repaired_sha256 string")


def report(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of rows in the
    form of damage() or plain()."""
    found = placed(faults(rows))
    extra = F.col("n") - 1
    stays = ~F.col("blank") & ~F.col("again")
    turn = F.when(F.col("dated"), F.col("turn"))
    counts = found.groupBy(*_KEY).agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(F.col("again"), F.col("n")).otherwise(extra)).alias("duplicate"),
        F.sum((stays & F.col("truncated")).cast("long")).alias("truncated"),
    )
    letters = cut(audits(tables(found)))
    facts = counts.join(letters, _KEY).join(digests(repaired(rows, letters)), _KEY)
    every = rows.groupBy(*_KEY).agg(F.count("*").alias("rows")).drop("rows")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(facts, _KEY, "left").select(F.when(F.col("named"), F.col("id")).alias("conv_id"), *(number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
