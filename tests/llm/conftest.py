"""Documents that hold the defined cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __row string, keys string"


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) rows: prose with copies, near copies, shared passages, repeated lines and odd texts."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéüßñ") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) + ("\n" if rng.random() < 0.05 else "") for _ in range(n))
    texts = [prose(rng.randint(1, 220)) for _ in range(60)]
    passage = prose(70)
    texts += [prose(30) + " " + passage + " " + prose(40) for _ in range(6)]
    texts += texts[:8] + [texts[3]] * 4
    for base in (texts[10], texts[11]):
        for _ in range(5):
            w = base.split(" ")
            w[rng.randrange(len(w))] = "edited"
            texts.append(" ".join(w))
    line = "one line that many texts have\nand a second line after it\nand a third"
    texts += [prose(20) + "\n" + line + "\n" + prose(20) for _ in range(4)] + ["\n".join(["same line"] * 9)]
    texts += ["", None, " \n\t ", "word", "a " * 300, prose(6000), "x" * 5000, "   odd　spaces \u0085 here", "a\x00b \x1c c"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[k]) for i, k in enumerate(order)]


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "r", "k") for i, t in corpus], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
