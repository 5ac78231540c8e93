import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the of and to in that was with for thing other under".split(), "de": "der die und nicht mit von über eine schön für ach".split(), "fr": "le de la été que être pas une très où dans".split()}


@pytest.fixture
def table(spark):
    """Rows of (doc_id, text[, lang[, source]]) as documents."""

    def make(rows, schema=SCHEMA):
        full = [(*r, *[None] * (4 - len(r)), None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture
def prose():
    r = random.Random(11)

    def make(n, lang="en", punctuation=True):
        words = [r.choice(WORDS[lang]) + r.choice(["", "", "er", "ing", "ly"]) for _ in range(n)]
        return " ".join(w + (r.choice([".", ",", "", "", "", "\n"]) if punctuation else "") for w in words)

    return make


@pytest.fixture
def odd(prose):
    """Rows with every oddity: null and empty texts, blanks, repeats, a null doc_id, a long text, odd characters."""
    long = prose(20_000)
    return [(1, None), (2, ""), (3, " \n\t"), (4, "Ab ab"), (4, "Ab ab"), (5, "ab AB"), (None, "no id here at all"), (7, "x" * 50_000), (8, long), (9, long + " end"), (10, "naïve Ünïcode ﬁne 😀 ４２ ½ —   x"), (11, "one"), (12, "!!! ??? ###")]
