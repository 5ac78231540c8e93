"""Mixing sources to target weights, by DataFrame operations only.

Documents fall into cells of source, language and topic. Iterative proportional fitting rakes the cells' token weights
until their sums by source, by language and by topic meet given targets; a document's calibrated probability is then
its cell's weight over its cell's tokens, times a rate, at most 1, where the rate is raised for what the cap takes.
A document is kept if a number drawn from a hash of its doc_id lies below its probability, so that any run, and any
other engine, keeps the same ones.

Targets are, unless given, shares in proportion to tokens to a power below 1 for each margin, which lifts small groups.
The cells are as many as there are combinations of margins, whatever the number of documents; raking runs over that
table until no margin is off its target by more than TOLERANCE of it, MOST rounds at most. Targets that contradict each
other, as where a source has one language only and both are to have other totals, cannot all be met; a warning then says
how far the worst margin is off. Up to FEW cells are raked by one expression over an array of them, more by windowed sums
that are shuffled by each margin, with lineage cut every ROUNDS rounds. Documents find their cell's probability by a
broadcast of the cells if these are few enough, else by a shuffle.

A topic is a column of the caller's. Without one, the class of letters that begins most of the text's words stands in
for it: it lets the third margin be raked, and says nothing about content.

Defined cases: null text has no tokens, probability of its cell and topic 0; null and empty source or lang are one
group; null doc_id is drawn as the text `null`; repeated rows are drawn alike; a cell without tokens has factor 1; an
empty table gives an empty result; other columns are kept by sample() and clash with none of its own.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exactdiff.llm.common import broadcast_if_small, cut, free_name

TOPICS = 4
#: Rounds between two looks at the margins, and at most; how far a margin may be off its target, as a part of it.
ROUNDS, MOST, TOLERANCE = 8, 96, 1e-9
#: Cells that one expression rakes.
FEW = 5_000
RATE = 0.7
#: Power of each margin's token share that makes its target share.
POWERS = {"source": 0.8, "lang": 0.85, "topic": 0.8}
_CAPS = 6


def n_tokens(text: Column) -> Column:
    """Words of a text: runs of what is not a space, a tab or a line break."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\r\n]+")), F.lit(0)).cast("long")


#: The classes of letters whose counts make a topic. Fixed values, one class for each topic.
CLASSES = ("abcdef", "ghijkl", "mnopqr", "stuvwxyz")


def topic_of(text: Column) -> Column:
    """0..TOPICS-1: the class of letters that begins most of the text's words; ties to the smaller, 0 without any."""
    counts = [F.coalesce(F.regexp_count(text, F.lit(rf"(?:^|[ \n])[{c}{c.upper()}]")), F.lit(0)) for c in CLASSES]
    return F.array_position(F.array(*counts), F.greatest(*counts)).cast("int") - 1


def uniform(doc_id: Column) -> Column:
    """A number of [0, 1) from the MD5 of the decimal doc_id: its first 32 bits by 2**32."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def measured(docs: DataFrame, topic: str | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, each margin's null as an empty string."""
    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"),
                       (F.coalesce(F.col(topic).cast("string"), F.lit("")) if topic else topic_of(F.col("text")).cast("string")).alias("topic"), n_tokens(F.col("text")).alias("tokens"))


def targets(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """margin, goal: tokens that each value should have, in all as many as there are."""
    each = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("t")).select(margin, F.pow("t", F.lit(power)).alias("p"), "t")
    total = each.agg(F.sum("t").alias("t"), F.sum("p").alias("p")).first()
    return each.select(margin, (F.col("p") * F.lit((total.t or 0.0) / (total.p or 1.0))).alias("goal"))


def margin_error(raked: DataFrame, margins: Iterable[str]) -> float:
    """The largest distance of a margin's weight from its goal, as a part of the goal; goals without tokens don't count."""
    off = [F.when((w > 0) & (F.col(f"goal_{m}") > 0), F.abs(w / F.col(f"goal_{m}") - 1)) for m in margins for w in (F.sum("weight").over(Window.partitionBy(m)),)]
    return raked.select(F.greatest(F.lit(0.0), *off).alias("off")).agg(F.max("off")).first()[0] or 0.0


def _rake_few(cells: DataFrame, margins: list[str], most: int, tolerance: float) -> tuple[DataFrame, float]:
    """cells (few, with goals) with weight, and the error left. A step sets one margin's factors to what its goals need
    under the factors of the others; a cell's weight is its tokens times its factors."""
    numbered = cells.coalesce(1)
    for i, m in enumerate(margins):
        numbered = numbered.withColumn(f"_{i}", F.dense_rank().over(Window.orderBy(m)) - 1)
    row = numbered.agg(F.collect_list(F.struct("*")).alias("all"))
    n = range(len(margins))
    for i in n:
        row = row.withColumn(f"by{i}", F.expr(f"transform(sequence(0, array_max(all._{i})), j -> filter(all, x -> x._{i} = j))")).withColumn(f"goal{i}", F.expr(f"transform(by{i}, g -> g[0].goal_{margins[i]})"))

    def step(i: int) -> str:
        product = " * ".join(["x.tokens", *(f"a.f{j}[x._{j}]" for j in n if j != i)])
        total = f"transform(by{i}, g -> aggregate(g, 0D, (t, x) -> t + {product}))"
        new = f"transform({total}, (t, j) -> if(t * a.f{i}[j] > 0, goal{i}[j] / t, a.f{i}[j]))"
        off = f"array_max(zip_with(a.f{i}, f, (x, y) -> coalesce(abs(x / y - 1), 0D)))"
        factors = ", ".join(f"'f{j}', {'f' if j == i else f'a.f{j}'}" for j in n)
        return f"transform(array({new}), f -> named_struct({factors}, 'off', transform(a.off, (x, j) -> if(j = {i}, {off}, x))))[0]"

    begin = "named_struct(" + ", ".join(f"'f{i}', transform(by{i}, g -> 1D)" for i in n) + f", 'off', array_repeat(1D, {len(margins)}))"
    steps = " ".join(f"WHEN {i} THEN {step(i)}" for i in n)
    loop = f"aggregate(sequence(1, {most * len(margins)}), {begin}, (a, k) -> if(array_max(a.off) <= {tolerance!r}D, a, CASE (k - 1) % {len(margins)} {steps} END))"
    # an empty table has no cell to number
    done = cut(row.where("size(all) > 0").withColumn("a", F.expr(loop)).select("all", "a"))
    error = done.agg(F.max(F.array_max("a.off"))).first()[0] or 0.0
    weight = " * ".join(["CAST(x.tokens AS DOUBLE)", *(f"a.f{i}[x._{i}]" for i in n)])
    return done.select("a", F.explode("all").alias("x")).select(*(F.col(f"x.{c}").alias(c) for c in cells.columns), F.expr(weight).alias("weight")), error


def rake(cells: DataFrame, goals: dict[str, DataFrame], most: int = MOST, tolerance: float = TOLERANCE, few: int = FEW) -> DataFrame:
    """cells with weight: tokens raked to the goals of each margin, one margin after the other, round by round."""
    raked = cells
    for margin, goal in goals.items():
        raked = raked.join(goal.withColumnRenamed("goal", f"goal_{margin}"), margin, "left")
    if cells.count() <= few:
        raked, error = _rake_few(raked, list(goals), most, tolerance)
    else:
        raked, error = cut(raked.withColumn("weight", F.col("tokens").cast("double"))), float("inf")
        for k in range(most):
            for margin in goals:
                total = F.sum("weight").over(Window.partitionBy(margin))
                raked = raked.withColumn("weight", F.when(total > 0, F.col("weight") * F.col(f"goal_{margin}") / total).otherwise(F.col("weight")))
            if k % ROUNDS == ROUNDS - 1 or k == most - 1:
                raked = cut(raked)
                error = margin_error(raked, goals)
                if error <= tolerance:
                    break
    if error > tolerance:
        warnings.warn(f"after {most} rounds a margin is off its target by {error:.2g} of it", stacklevel=2)
    return raked.drop(*(f"goal_{m}" for m in goals))


def probabilities(cells: DataFrame, rate: float = RATE, powers: dict[str, float] = POWERS) -> DataFrame:
    """source, lang, topic, weight, probability of each cell. cells: also tokens."""
    cells = cut(cells)
    raked = cut(rake(cells, {m: targets(cells, m, p) for m, p in powers.items()}))
    factor = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(1.0))
    raked = raked.withColumn("factor", factor)
    wanted = rate * float(raked.agg(F.sum("tokens")).first()[0] or 0)
    c = rate
    for _ in range(_CAPS):
        capped = F.col("factor") * c >= 1
        full, free = raked.agg(F.sum(F.when(capped, F.col("tokens")).otherwise(0)), F.sum(F.when(~capped, F.col("weight")).otherwise(0.0))).first()
        if not full or not free:
            break
        c = max(c, (wanted - full) / free)
    return raked.select("source", "lang", "topic", "weight", F.least(F.lit(1.0), F.col("factor") * c).alias("probability"))


def calibrated(docs: DataFrame, rate: float = RATE, topic: str | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, probability, sampled: a row for each document."""
    rows = cut(measured(docs, topic))
    cells = rows.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    p = probabilities(cells, rate)
    return rows.join(broadcast_if_small(p.drop("weight")), ["source", "lang", "topic"]).select("doc_id", "source", "lang", "topic", "tokens", "probability", (uniform(F.col("doc_id")) < F.col("probability")).alias("sampled"))


def sample(docs: DataFrame, rate: float = RATE, topic: str | None = None) -> DataFrame:
    """The documents drawn, with all their columns."""
    p_name = free_name(docs.columns, "probability")
    keys = {m: free_name(docs.columns, f"cell_{m}") for m in ("source", "lang", "topic")}
    cells = measured(docs, topic).groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    p = probabilities(cells, rate).select(*(F.col(m).alias(k) for m, k in keys.items()), F.col("probability").alias(p_name))
    own = docs.select("*", F.coalesce("source", F.lit("")).alias(keys["source"]), F.coalesce("lang", F.lit("")).alias(keys["lang"]), (F.coalesce(F.col(topic).cast("string"), F.lit("")) if topic else topic_of(F.col("text")).cast("string")).alias(keys["topic"]))
    return own.join(broadcast_if_small(p), list(keys.values())).where(uniform(F.col("doc_id")) < F.col(p_name)).select(*(F.col(f"`{c}`") for c in docs.columns))
