"""Every registered query on odd tables: clashing column names, repeated and null rows, very long texts, and no rows."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

#: Names that operators use inside or return; as extra columns of the input they must not matter.
CLASHING = ["node", "token", "info", "n", "bin", "range", "place", "score", "labels", "component_id", "ids", "fingerprint", "spans", "part", "x", "copy"]
COLUMNS = {
    "op1_ngram_join": {"doc_id", "n_shingles", "component_id"},
    "op3_token_output": {"sequence_id", "ids", "cumulative_lengths", "position_resets"},
    "op4_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op5_quality": {"doc_id", "held_out", "score", "predicted"},
    "op7_fingerprint": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op8_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op9_license_scan": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
    "op10_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op12_byte_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
}
ONE_ROW_EACH = ["op1_ngram_join", "op5_quality", "op7_fingerprint", "op8_language_id", "op9_license_scan", "op10_pii", "op12_byte_bpe"]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    import random

    r = random.Random(17)
    words = {"en": "the of and to in that was with", "de": "der die und nicht mit von eine", "fr": "le de la que être pas une dans"}
    prose = lambda n, lang: " ".join(r.choice(words[lang].split()) + r.choice(["", "", "er", "ing"]) for _ in range(n))
    rows = [(i, prose(30, lang), lang, f"s{i % 3}") for i, lang in enumerate(["en", "de", "fr"] * 20)]
    rows += [(100, None, None, None), (101, "", "en", "s0"), (102, " \n\t", "de", None), (None, "no id here at all", "en", "s1"), (103, "!!! ???", "en", "s0"), (104, "Ab ab", "en", "s0"), (104, "Ab ab", "en", "s0"), (105, prose(220_000, "en"), "en", "s2")]
    assert max(len(x[1] or "") for x in rows) > 1_000_000
    full = [(*x, None if x[1] is None else len(x[1])) for x in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    labels = [(i, int(len(set((t or "").split())) > 12), 0) for i, t, *_ in rows if i is not None and i < 60]
    out = {}
    for name, some, marks in (("odd", full, labels), ("none", [], [])):
        at = tmp_path_factory.mktemp(name)
        docs = spark.createDataFrame(some, schema)
        for k, c in enumerate(CLASHING):
            docs = docs.withColumn(c, F.lit(k))
        docs.write.parquet(str(at / "documents.parquet"))
        spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
        out[name] = str(at)
    return out, rows


@pytest.mark.parametrize("name", COLUMNS)
def test_query_on_odd_documents(spark, folders, name):
    at, rows = folders
    found = entry.queries()[name](spark, at["odd"])
    assert COLUMNS[name] <= set(found.columns)
    got = found.select(*(c for c in found.columns if c != "ids")).collect()
    assert got
    if name in ONE_ROW_EACH:
        order = lambda x: sorted(x, key=lambda i: (i is not None, i))
        assert order(r.doc_id for r in got) == order(x[0] for x in rows)
    if name == "op5_quality":
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    if name == "op8_language_id":
        assert {r.lang_pred for r in got if r.doc_id in (100, 101, 102, 103)} == {"und"}


@pytest.mark.parametrize("name", [n for n in COLUMNS if n not in ("op5_quality", "op8_language_id")])
def test_query_on_no_documents(spark, folders, name):
    assert entry.queries()[name](spark, folders[0]["none"]).count() == 0
