import random

import pytest

SYLLABLES = {"en": ["th", "he", "er", "ing", "and", "sh", "ou"], "de": ["sch", "ei", "ung", "ö", "tz", "ein", "ver"], "fr": ["eau", "oi", "é", "que", "ç", "ment", "ai"], "ru": ["при", "вет", "ко", "но", "ст"]}


def word(r, lang="en"):
    return "".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3)))


def prose(r, n, lang="en", per_line=12):
    w = [word(r, lang) for _ in range(n)]
    return "\n".join(" ".join(w[i : i + per_line]) for i in range(0, n, per_line))


#: Texts that every operator must take: null, empty, blank, one word, very long, repeated.
ODD = [None, "", "  \n\t ", "one", "x" * 50_000, "same text " * 3, "same text " * 3, "a\x0bb\x0cc\rd é ñ 漢字 🎉", "!!! ??? 123"]

#: Extra columns whose names clash with such as operators may use.
EXTRA = ["k", "f", "sig", "key", "words", "__key", "__hs", "C0", "order", "score"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in EXTRA)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts among others, null ids and sources, repeated rows, clashing columns."""
    r = random.Random(1)
    rows = []
    for i, t in enumerate([*ODD, *(prose(r, 60) for _ in range(8)), *(prose(r, 40, "de") for _ in range(4))]):
        rows.append((i, t, "en" if i < 17 else "de", ["s1", "s2", None][i % 3], len(t or "") or None, *range(len(EXTRA))))
    rows += [(None, "no id here at all my friend", None, None, None, *[None] * len(EXTRA))] * 2
    rows += [rows[10], rows[10]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
