"""Canonical exact digests, by DataFrame operations only.

A text's canonical form is NFKC, full case folding, NFKC again, white space runs to one space, none at the ends. ICU,
which Spark ships for its collations, does the Unicode part through Spark's `reflect`; texts of ASCII only skip it.
The digest is two 64-bit xxhashes of the form, with different seeds, and its length. Texts of equal digest are compared
byte by byte: their canonical forms are grouped with the digest, copies combining before they are shuffled, and if a
digest has several forms, those after the first in byte order get a number behind the digest. So equal fingerprints
mean equal canonical texts, always.

Defined cases: null text counts as empty, and empty texts share a fingerprint; an empty table gives an empty result;
repeated rows keep their rows. Columns of the input stay, but for one named fingerprint.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exactdiff.llm.common import broadcast_if_small, cut

#: Seeds of the two hashes, put before the text. Fixed values.
SEEDS = (11, 1_000_003)
#: Bytes of text in a range of documents, about, and the parts that a span of doc_ids is cut into at least.
RANGE_BYTES, PARTS = 16_000_000, 64
#: Code points that count as white space beside those of Unicode's property. Fixed pattern.
SPACE = r"(?U)[\s\x{1C}-\x{1F}\x{85}]+"


def _icu(owner: str, method: str, text: Column, flag: bool) -> Column:
    return F.call_function("reflect", F.lit(f"com.ibm.icu.{owner}"), F.lit(method), text, F.lit(flag))


def canonical(text: Column) -> Column:
    """The canonical form of a text column."""
    text = F.coalesce(text, F.lit(""))
    compose = lambda x: _icu("text.Normalizer", "compose", x, True)
    folded = compose(_icu("lang.UCharacter", "foldCase", compose(text), True))
    wide = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(folded)
    return F.trim(F.regexp_replace(wide, SPACE, " "))


def digest(form: Column) -> Column:
    """The digest of a canonical form: 128 bits of xxhash and the length in bytes, in hexadecimal."""
    parts = [F.lpad(F.hex(F.xxhash64(F.lit(seed), form)), 16, "0") for seed in SEEDS]
    return F.lower(F.concat(*parts, F.lit("-"), F.hex(F.octet_length(form))))


def semi(df: DataFrame, few: DataFrame, on: dict[str, str]) -> DataFrame:
    """The rows of df whose columns are those of a row of few, null being equal to null. on: df's columns to few's."""
    names = {c: f"__few_{i}" for i, c in enumerate(on)}
    side = broadcast_if_small(cut(few.select(*(F.col(v).alias(names[c]) for c, v in on.items())).distinct()))
    return df.join(side, reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(n)) for c, n in names.items())), "left_semi")


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text", kept: list[str] | None = None, again: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """keys, the columns kept, and fingerprint, for each row of texts; keys need not be unique.

    Texts are read twice: for all digests, and for the bytes of those that several rows have. again: gives the texts, in
    a column `text`, for rows of keys and kept; it may give more. Without it they are taken from texts.
    """
    kept = kept or []
    form = canonical(F.col(text))
    small = cut(texts.select(*keys, *kept, digest(form).alias("fingerprint")))
    many = cut(small.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint"))
    suspects = cut(small.join(broadcast_if_small(many), "fingerprint", "left_semi").select(*keys, *kept).distinct())
    found = again(suspects) if again else semi(texts, suspects, {k: k for k in keys}).select(F.col(text).alias("text"))
    form = canonical(F.col("text"))
    forms = found.select(form.alias("form")).select(digest(F.col("form")).alias("fingerprint"), "form").groupBy("fingerprint", "form").agg(F.count("*").alias("n"))
    # one row for each different form; almost always one for each digest
    clashing = cut(forms.groupBy("fingerprint").agg(F.count("*").alias("forms"), F.collect_set(F.sha2("form", 256)).alias("x")).where("forms > 1"))
    if clashing.isEmpty():
        return small
    rank = F.row_number().over(Window.partitionBy("fingerprint").orderBy("form"))
    numbered = forms.join(clashing.select("fingerprint"), "fingerprint", "left_semi").select("fingerprint", "form", rank.alias("k"))
    named = texts.select(*keys, *kept, canonical(F.col(text)).alias("form")).withColumn("fingerprint", digest(F.col("form"))).join(numbered, ["fingerprint", "form"], "left")
    return named.select(*keys, *kept, F.when(F.col("k") > 1, F.concat("fingerprint", F.lit("."), F.col("k"))).otherwise(F.col("fingerprint")).alias("fingerprint"))


def _in_cell() -> Column:
    """The number of the part of its cell's span that a row's doc_id lies in; it never falls as doc_id grows, and the ends
    of a span lie in different parts."""
    wide = lambda x: F.col(x).cast("decimal(20,0)")  # noqa: E731  # the difference of two longs may be no long
    part = F.floor((wide("doc_id") - wide("low")).cast("double") / (wide("high") - wide("low")).cast("double") * F.col("parts"))
    return F.when(F.col("parts") > 1, F.least(part, F.col("parts") - 1)).otherwise(0)


def _cells(sizes: DataFrame, size: int) -> list[DataFrame]:
    """Tables that lead a row to its cell of doc_ids, one after the other: bin, low, high, parts and first (the number of
    the bin's first part). Cells of more than `size` bytes are cut into parts of their own span of doc_ids until each
    holds less or a single doc_id, so doc_ids that lie close together, or far off, make no large cell. sizes: doc_id, n."""
    out: list[DataFrame] = []
    placed = sizes.withColumn("bin", F.col("doc_id").isNotNull().cast("long"))
    while True:
        each = cut(placed.groupBy("bin").agg(F.sum("n").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")))
        parts = F.when((F.col("n") > size) & (F.col("low") < F.col("high")), F.greatest(F.lit(PARTS), F.ceil(2 * F.col("n") / size))).otherwise(1)
        table = each.select("bin", "n", "low", "high", parts.cast("long").alias("parts"))
        # a row for each cell, some 16 for each range of the result
        first = F.coalesce(F.sum("parts").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        out.append(cut(table.withColumn("first", first)))
        if out[-1].where("parts > 1").isEmpty():
            return out
        placed = _split(placed, out[-1])


def _split(placed: DataFrame, table: DataFrame) -> DataFrame:
    """placed with the bins of the next table."""
    names = [c for c in placed.columns if c != "bin"]
    found = placed.join(broadcast_if_small(table.drop("n")), "bin")
    return found.select(*names, (F.col("first") + _in_cell()).alias("bin"))


def with_next(docs: DataFrame, size: int = RANGE_BYTES, place: bool = False) -> DataFrame:
    """doc_id, text (null: empty), next_id, next_text: the row that follows by doc_id, after the last the first; and, if
    asked for, range and place, which name a row.

    Rows are dealt to ranges of doc_id that hold about `size` bytes of text, however doc_ids are spread, each range
    together with a copy of the first row of the next, so that texts are shuffled once. Rows of one doc_id, or of none,
    stand in one range and follow each other by text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = cut(rows.select("doc_id", (F.octet_length("text") + 64).cast("long").alias("n")))
    *splits, last = _cells(sizes, size)
    before = F.coalesce(F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = cut(last.select("bin", F.floor(before / size).alias("r")).select("bin", (F.dense_rank().over(Window.orderBy("r")) - 1).alias("range")))
    ranges = (bins.agg(F.max("range")).first()[0] or 0) + 1
    placed = rows.withColumn("bin", F.col("doc_id").isNotNull().cast("long"))
    for table in splits:
        placed = _split(placed, table)
    ranged = placed.join(broadcast_if_small(bins), "bin").select("range", F.lit(0).alias("copy"), "doc_id", "text")
    firsts = ranged.groupBy("range").agg(F.min(F.struct("doc_id", "text")).alias("x"))
    firsts = firsts.select(F.pmod(F.col("range") - 1, F.lit(ranges)).alias("range"), F.lit(1).alias("copy"), "x.doc_id", "x.text")
    w = Window.partitionBy("range").orderBy("copy", F.col("doc_id").asc_nulls_first(), "text")
    linked = ranged.union(firsts).select("range", F.row_number().over(w).alias("place"), "copy", "doc_id", "text", F.lead("doc_id").over(w).alias("next_id"), F.lead("text").over(w).alias("next_text"))
    return linked.where("copy = 0").select(*(["range", "place"] if place else []), "doc_id", "text", "next_id", "next_text")


def edited(text: Column, other: Column) -> Column:
    """text with its last floor(n/2) code points replaced by the first as many of other."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))
