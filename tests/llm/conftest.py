import random

import pytest

from tidelog.llm.common import prepare



@pytest.fixture(autouse=True)
def settings(spark):
    prepare(spark)


def prose(seed: int, n: int) -> str:
    """Words from a small vocabulary, with stops, capitals and some accents."""
    rng = random.Random(seed)
    words = [rng.choice("the of and to in a is that for it on was der die und les une que".split()) if rng.random() < 0.4 else "".join(rng.choices("aeioubdgklmnprstvéüñ", k=rng.randint(3, 9))) for _ in range(n)]
    return " ".join(w.capitalize() if i % 9 == 0 else w + "." if i % 9 == 8 else w for i, w in enumerate(words))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls anywhere, empty, blank, short and very long texts, repeated rows, ties, and extra columns with clashing names."""
    long = prose(1, 60_000)
    passage = prose(2, 60)
    rows = [
        (1, prose(3, 120) + "\n" + passage, "en", "s"),
        (1, prose(3, 120) + "\n" + passage, "en", "s"),
        (1, "another text under the same id", "en", None),
        (2, None, "en", "s"),
        (3, "", None, "s"),
        (4, " \t\n\r\x0b\x0c ", "fr", "s"),
        (5, long, "en", "s"),
        (6, long + " one more word", "en", "s"),
        (None, passage + "\n" + prose(4, 40), "de", "s"),
        (None, None, None, None),
        (7, "<|endoftext|>İstanbul’s ΑΣ é naïve 3½ 漢字 🙂 don't stop <|startoftext|>x", "xx", "s"),
        (8, "word", "en", "s"),
        (9, "\n".join([passage] * 3 + ["Page 3 of 9", "page 4 of 11"]), "en", "s"),
        (50, prose(3, 120), "en", "s"),
        (100, prose(3, 120).upper(), "en", "s"),
    ]
    extra = [(*r, 0 if r[1] is None else len(r[1]), f"k{i}", i, i, "x") for i, r in enumerate(rows)]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, key string, id int, count int, word string")
