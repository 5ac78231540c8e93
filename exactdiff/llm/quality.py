"""Quality classifier: a sparse ensemble of rules.

A text is described by statistics, each a Spark column expression over the whole text. Boosted shallow trees are grown
on a bounded sample of labelled rows; every path from a root to a node is a rule, a conjunction of comparisons of
statistics with constants. A logistic regression with an L1 penalty weighs the rules and drops most; those left are
compiled into one Spark column expression, so scoring is a projection of the scan without Python or a shuffle.

The sample holds at most about MAX_ROWS labelled documents, chosen by a hash of doc_id among those not held out.

Defined cases: null text counts as empty, and empty texts have a score; repeated rows are scored alike; labels that
are neither 0 nor 1 are left out; labels of one kind only, or none, give their share (0.5 without any) to all; an
empty table gives an empty result; clashing names of other columns do not matter, as only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exactdiff.llm.language_id import held_out

MAX_ROWS = 6000
TREES, DEPTH, CUTS, LEAST = 40, 3, 24, 12
RATE = 0.3
PENALTY = 0.002
STEPS = 400


def statistics(text: Column) -> dict[str, Column]:
    """Each statistic's name and expression. text: not null."""
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.split(text, r"[ \t\r\n]+")
    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
    lines = F.split(text, "\n")
    n_lines = F.greatest(F.size(lines), F.lit(1)).cast("double")
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    return {
        "chars": F.length(text).cast("double"),
        "word_length": chars / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / F.sqrt(n_words),
        "word_variety": F.size(F.array_distinct(words)) / n_words,
        "words_a_line": n_words / n_lines,
        "line_variety": F.size(F.array_distinct(lines)) / n_lines,
        "upper": count(r"\p{Lu}") / chars,
        "digits": count("[0-9]") / chars,
        "marks": count(r"[^\p{L}\p{Nd}\s]") / chars,
        "odd_marks": count(r"[#$%&*|<>{}\[\]\\^~=_@+]") / chars,
        "stops": count(r"[.!?](?=\s|$)") / n_words,
        "shouts": count("!") / n_words,
    }


STATISTICS = ["chars", "word_length", "distinct_words", "word_variety", "words_a_line", "line_variety", "upper", "digits", "marks", "odd_marks", "stops", "shouts"]


def described(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of its text, prefixed s_."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    return rows.select("doc_id", *(x.alias(f"s_{k}") for k, x in statistics(F.col("t")).items()))


Test = tuple[int, bool, float]  # statistic, whether above, bound
Rule = tuple[Test, ...]


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for i, above, bound in rule:
        out &= (x[:, i] > bound) if above else (x[:, i] <= bound)
    return out


def _split(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray) -> tuple[float, int, float] | None:
    """The gain, statistic and bound of the best split by second-order gain."""
    best = None
    total_g, total_w = gradient.sum(), weight.sum()
    for i in range(x.shape[1]):
        values = np.sort(x[:, i])
        places = np.unique(np.linspace(0, len(values) - 1, CUTS + 2).astype(int)[1:-1])
        bounds = np.unique((values[places] + values[np.minimum(places + 1, len(values) - 1)]) / 2)
        low = x[:, i][:, None] <= bounds[None, :]
        n = low.sum(0)
        g, w = gradient @ low, weight @ low
        gain = g * g / (w + 1) + (total_g - g) ** 2 / (total_w - w + 1) - total_g**2 / (total_w + 1)
        gain[(n < LEAST) | (len(x) - n < LEAST)] = -1
        k = int(np.argmax(gain))
        if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
            best = float(gain[k]), i, float(bounds[k])
    return best


def grow(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The rules of boosted trees on rows x with labels y, each once."""
    random = np.random.default_rng(7)
    score = np.full(len(x), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        gradient, weight = y - p, p * (1 - p)
        drawn = random.random(len(x)) < 0.6
        open_nodes: list[Rule] = [()]
        leaves: list[Rule] = []
        for _depth in range(DEPTH):
            deeper = []
            for rule in open_nodes:
                here = _holds(x, rule) & drawn
                found = _split(x[here], gradient[here], weight[here]) if here.sum() >= 2 * LEAST else None
                if found is None:
                    leaves.append(rule)
                    continue
                for above in (False, True):
                    child = (*rule, (found[1], above, found[2]))
                    rules[child] = None
                    deeper.append(child)
            open_nodes = deeper
        for rule in [*leaves, *open_nodes]:
            here = _holds(x, rule)
            if here.any():
                score[here] += RATE * gradient[here].sum() / (weight[here].sum() + 1)
    return list(rules)


@dataclass(frozen=True)
class Model:
    base: float
    rules: list[tuple[float, Rule]]

    def expression(self) -> Column:
        """The score as a column over described() rows."""
        total = F.lit(self.base)
        for weight, rule in self.rules:
            met = F.lit(True)
            for i, above, bound in rule:
                s = F.col(f"s_{STATISTICS[i]}")
                met = met & ((s > bound) if above else (s <= bound))
            total = total + F.when(met, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> Model:
    """Rules grown on x and y (0 or 1), and their weights by proximal gradient steps with momentum."""
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return Model(float(np.log(share / (1 - share))), [])
    rules = grow(x, y)
    a = np.column_stack([_holds(x, r) for r in rules]).astype(np.float32)
    w, b = np.zeros(a.shape[1], np.float32), float(np.log(y.mean() / (1 - y.mean())))
    z, zb, t = w.copy(), b, 1.0
    v = np.ones(a.shape[1], np.float32)
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 4 * len(y) / (float(v @ (a.T @ (a @ v))) + len(y))
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-(a @ z + zb))) - y
        new = z - step * (a.T @ error) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = zb - step * float(error.mean())
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / u * (new - w), new_b + (t - 1) / u * (new_b - b)
        w, b, t = new, new_b, u
    return Model(b, [(float(k), r) for k, r in zip(w, rules) if abs(k) > 1e-4])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = MAX_ROWS) -> Model:
    """A model of the labels of documents that are not held out, from about `rows` of them at most."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(~held_out() & F.col("y").isin(0, 1))
    n = usable.count()
    spread = F.shiftrightunsigned(F.xxhash64(F.lit(5), "doc_id"), 11).cast("double") / float(1 << 53)
    some = usable.where(spread < min(1.0, rows / max(1, n)))
    # as many rows as the bound on the sample allows, each of two numbers
    found = described(docs.join(F.broadcast(some.select("doc_id").distinct()), "doc_id", "left_semi")).join(F.broadcast(some), "doc_id").orderBy("doc_id", "y").collect()
    x = np.array([[r[f"s_{k}"] for k in STATISTICS] for r in found], float).reshape(-1, len(STATISTICS))
    return fit(x, np.array([r.y for r in found], float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of each document."""
    return described(docs).select("doc_id", model.expression().alias("score"))
