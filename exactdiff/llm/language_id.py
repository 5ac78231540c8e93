"""Language identification by prediction by partial matching.

Each language has a context tree of byte strings of up to three bytes, with the counts of the bytes that followed.
A byte's probability follows escape method C with exclusion: `count / (n + q)` for one of the q bytes that a context
has seen n times in all, else the escape `q / (n + q)` times what the next shorter context gives the bytes not seen,
down to a uniform code over the alphabet. The statistics are frozen after training, so the code length of a byte is a
function of it and of the three bytes before it. fit() writes those lengths out as a table, in 256ths of a bit:
a row for each context of the trees' union, found through the last three bytes, and in it for each byte the length
under each language. Scoring a text is a lookup for each byte and an exact integer sum, over whole texts, by numpy.

Training reads a bounded sample: of each language, documents chosen by a hash of doc_id so that about SAMPLE_BYTES
bytes come, of documents up to MAX_DOC_BYTES. The trees hold the CONTEXTS most frequent contexts.

Defined cases: null text, or one without a letter, is `und` with score 0; empty tables give empty results; ties go to
the language that sorts first; a training set without any usable row makes every document `und`. A document whose
doc_id is null counts as held out. Other columns of the input are kept; those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exactdiff.llm.common import release
from exactdiff.llm.words import buffers

SAMPLE_BYTES = 1_000_000
MAX_DOC_BYTES = 100_000
CONTEXTS = 8_000
#: Lengths are in this part of a bit.
UNIT = 256
_BLOCK = 1 << 18
UND = "und"
_LETTERS = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray  # of each byte: its number in the alphabet, 0 for bytes never seen
    size: int  # of the alphabet, with 0
    row: np.ndarray  # of three numbers a, b, c as (a * size + b) * size + c: the table's row
    cost: np.ndarray  # row, byte's number, language

    def limit(self) -> float:
        """Bits a byte from which a text is no better than noise under any language."""
        return float(np.log2(self.size))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True for the documents that nothing is learned from: crc32 of the decimal doc_id divisible by 5, or no doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def sample(docs: DataFrame, bytes_each: int = SAMPLE_BYTES, largest: int = MAX_DOC_BYTES) -> dict[str, list[bytes]]:
    """Of each language about bytes_each bytes of whole texts, chosen by a hash of doc_id."""
    usable = docs.select("doc_id", "lang", "text", F.octet_length("text").alias("size")).where(f"lang is not null and size between 1 and {largest}")
    part = {r.lang: min(1.0, bytes_each / r.total) for r in usable.groupBy("lang").agg(F.sum("size").alias("total")).collect()}
    if not part:
        return {}
    spread = (F.shiftrightunsigned(F.xxhash64("doc_id"), 11)).cast("double") / float(1 << 53)
    kept = usable.where(spread < F.create_map(*[F.lit(x) for kv in part.items() for x in kv])[F.col("lang")])
    found: dict[str, list[bytes]] = {x: [] for x in part}
    for r in kept.orderBy("doc_id").select("lang", "text").toLocalIterator():
        found[r.lang].append(r.text.encode())
    return {k: v for k, v in sorted(found.items()) if v}


def fit(texts: dict[str, list[bytes]], contexts: int = CONTEXTS) -> Model:
    """The table of code lengths for texts of each language."""
    languages = sorted(texts)
    seen = np.zeros(256, bool)
    raw = {k: np.frombuffer(b"".join(texts[k]), np.uint8) for k in languages}
    for x in raw.values():
        seen[np.unique(x)] = True
    code = np.zeros(256, np.int64)
    code[seen] = np.arange(1, int(seen.sum()) + 1)
    k = int(seen.sum()) + 1
    counts: list[dict] = []  # of each order: context -> counts[language, byte]
    grams = []
    for name in languages:
        c = code[raw[name]]
        begin = np.zeros(len(c), bool)
        begin[np.cumsum([0, *map(len, texts[name][:-1])])] = True
        before, parts = [c], []
        far = np.zeros(len(c), np.int64)  # bytes since the text began
        at = np.flatnonzero(begin)
        far = np.arange(len(c)) - np.repeat(at, np.diff(np.append(at, len(c))))
        for back in (1, 2, 3):
            x = np.zeros(len(c), np.int64)
            x[back:] = c[:-back]
            x[far < back] = 0
            before.append(x)
        context = np.zeros(len(c), np.int64)
        for order in range(4):
            if order:
                context = context + before[order] * k ** (order - 1)
            parts.append(np.unique(context * k + c, return_counts=True))
        grams.append(parts)
    for order in range(4):
        table: dict[int, np.ndarray] = {}
        total: dict[int, int] = {}
        for parts in grams:
            key, n = parts[order]
            for context, m in zip(*(lambda u, i: (u.tolist(), np.bincount(i, weights=n).tolist()))(*np.unique(key // k, return_inverse=True))):
                total[context] = total.get(context, 0) + int(m)
        kept = set(sorted(total, key=lambda x: (-total[x], x))[:contexts])
        for which, parts in enumerate(grams):
            key, n = parts[order]
            for g, m in zip(key.tolist(), n.tolist()):
                if g // k in kept:
                    table.setdefault(g // k, np.zeros((len(languages), k)))[which, g % k] = m
        counts.append(table)
    share: list[dict[int, np.ndarray]] = []
    for order, table in enumerate(counts):
        found = {}
        for context, n in table.items():
            low = share[order - 1].get(context % k ** (order - 1)) if order else np.full((len(languages), k), 1 / k)
            if low is None:
                continue
            known = n > 0
            q, total = known.sum(1, keepdims=True), n.sum(1, keepdims=True)
            rest = np.where(known, 0, low)
            left = rest.sum(1, keepdims=True)
            escape = np.where(left > 0, q, 0)
            p = np.where(known, n, 0) / np.maximum(total + escape, 1) + rest / np.maximum(left, 1e-300) * escape / np.maximum(total + escape, 1)
            found[context] = np.where(total > 0, p, low)
        share.append(found)
    order3 = list(share[3].items())
    rows = [share[0].get(0, np.full((len(languages), k), 1 / k))]
    row = np.zeros((k, k, k), np.int32)  # [third before, second before, last]
    for context, p in share[1].items():
        row[:, :, context] = len(rows)
        rows.append(p)
    for context, p in share[2].items():
        row[:, context // k, context % k] = len(rows)
        rows.append(p)
    for context, p in order3:
        row[context // k**2, context // k % k, context % k] = len(rows)
        rows.append(p)
    # a row at a time: all of them as floating-point numbers would be the driver's largest array
    cost = np.stack([np.clip(np.rint(-np.log2(np.maximum(p, 2.0**-60)) * UNIT), 1, 65535).astype(np.uint16) for p in rows])
    return Model(languages, code, k, row.reshape(-1), np.ascontiguousarray(cost.transpose(0, 2, 1)))


def lengths(model: Model, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code lengths of each row under each language, in UNITs; raw and at as words.buffers() gives them."""
    out = np.zeros((len(at) - 1, len(model.languages)), np.int64)
    k = model.size
    for lo in range(0, len(raw), _BLOCK):
        hi = min(lo + _BLOCK, len(raw))
        head = min(lo, 3)
        c = model.code[raw[lo - head : hi]]
        rows = np.arange(np.searchsorted(at, lo, side="right") - 1, np.searchsorted(at, hi, side="left"))
        context = np.zeros(len(c), np.int64)
        begin = at[rows] - (lo - head)
        for back in (1, 2, 3):
            x = np.zeros(len(c), np.int64)
            x[back:] = c[:-back]
            for d in range(back):
                y = begin + d
                x[y[(y >= 0) & (y < len(c))]] = 0
            context += x * k ** (back - 1)
        cost = model.cost[model.row[context[head:]], c[head:]]
        rows = rows[(at[rows + 1] > at[rows]) & (at[rows + 1] > lo) & (at[rows] < hi)]
        if len(rows):
            out[rows] += np.add.reduceat(cost, np.maximum(at[rows] - lo, 0), axis=0, dtype=np.int64)
    return out


def _has_letter(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(_LETTERS[raw])))
    found = total[at[1:]] > total[at[:-1]]
    for i in np.flatnonzero(~found & (at[1:] > at[:-1])):
        found[i] = any(x.isalpha() for x in raw[at[i] : at[i + 1]].tobytes().decode(errors="replace"))
    return found


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1) and bits (a byte, under lang_pred; null for und)."""
    results = [("lang_pred", "string"), ("score", "double"), ("bits", "double")]
    kept = [f for f in docs.schema.fields if f.name.lower() not in {x for x, _ in results}]
    docs = docs.select([F.col(f"`{f.name}`") for f in kept])
    at_text = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for lo in range(0, len(whole), 500):
                b = whole.slice(lo, 500)
                raw, at = buffers(b.column(at_text))
                size = at[1:] - at[:-1]
                named = _has_letter(raw, at) if m.languages else np.zeros(len(b), bool)
                lang, score, bits = [UND] * len(b), np.zeros(len(b)), np.full(len(b), np.nan)
                if m.languages:
                    n = lengths(m, raw, at)
                    best = n.argmin(1)
                    least = n[np.arange(len(b)), best]
                    # how far the others lie behind, in bits by the root of the text's length
                    behind = (n - least[:, None]) / UNIT / np.sqrt(np.maximum(size, 1))[:, None]
                    sure = 1 / np.exp2(-np.minimum(behind, 1000)).sum(1)
                    for i in np.flatnonzero(named):
                        lang[i], score[i], bits[i] = m.languages[best[i]], sure[i], least[i] / UNIT / size[i]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(bits, mask=np.isnan(bits))], names=[*b.schema.names, "lang_pred", "score", "bits"])
            release()

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    kinds = {"string": StringType(), "double": DoubleType()}
    return docs.mapInArrow(run, StructType([*kept, *(StructField(x, kinds[k]) for x, k in results)]))


def train(docs: DataFrame, bytes_each: int = SAMPLE_BYTES) -> Model:
    """A model learned from text and lang of the documents that are not held out."""
    texts = sample(docs.where(~held_out()), bytes_each)
    model = fit(texts) if texts else Model([], np.zeros(256, np.int64), 1, np.zeros(1, np.int32), np.zeros((1, 1, 0), np.uint16))
    del texts
    release()
    return model


def accepted(predicted: DataFrame, model: Model) -> DataFrame:
    """The rows that are text of a known language: not und, and shorter than noise under the language's code."""
    return predicted.where((F.col("lang_pred") != UND) & (F.col("bits") < model.limit()))
