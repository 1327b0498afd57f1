import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "found string, kept string, score double, entities string, pack string, gone_ long"
)


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text), with extra columns of clashing names."""

    def make(*rows):
        full = [(i, t, "en", "s", None if t is None else len(t), "x", "y", 0.5, "z", "p", 7) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Texts of every awkward kind: null, empty, blank, repeated, long, odd letters."""
    rng = random.Random(5)
    words = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    texts = [None, "", " \n\t ", "a", "é 日本 🎉", "one two three four", prose(40), prose(40) + "\n" + prose(9)]
    texts += [prose(rng.randint(5, 60)) for _ in range(20)] + [prose(6000)]
    base = prose(80).split(" ")
    texts += [" ".join(base)] * 3
    for _ in range(12):  # near copies of one another, by way of the base
        copy = list(base)
        copy[rng.randrange(len(copy))] = "changed"
        texts.append(" ".join(copy))
    return list(enumerate(texts))
