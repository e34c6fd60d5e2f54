import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep long, g long"


def prose(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Texts with shared passages, exact and near copies, loops, short, empty and null ones."""
    rnd = random.Random(3)
    passages = [prose(rnd, 60) for _ in range(3)]
    out = [prose(rnd, rnd.randint(1, 160)) for _ in range(30)]
    out += [prose(rnd, 30) + "\n" + passages[i % 3] + "\t" + prose(rnd, 25) for i in range(12)]
    base = prose(rnd, 120)
    for _ in range(8):
        w = base.split()
        w[rnd.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [base, base, base.replace(" ", "  \n"), base.upper(), None, "", " \n ", "one", "one two", "ab " * 300, "x" * 900, "é" * 500, "日本 " * 150, base + " " + base]
    return out


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """With columns whose names clash with those that operators use inside."""
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", "a", None][i % 4], len(t or ""), 7, 7) for i, t in enumerate(corpus)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def doubled(spark):
    """Rows that share an id, whole or not, and null ids."""
    a, b = " ".join(f"p{i}" for i in range(70)), " ".join(f"q{i}" for i in range(70))
    rows = [(1, a), (1, a), (2, b), (2, a + " " + b), (None, b), (None, None), (3, None)]
    return spark.createDataFrame([(i, t, None, None, None, 1, 1) for i, t in rows], SCHEMA)
