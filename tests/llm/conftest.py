import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, body string, fp bigint, score double, hash bigint"


def frame(spark, rows):
    """documents with extra columns whose names the operators use too."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "x", 1, 0.5, 2) for i, t in rows], SCHEMA)


def prose(rng, n):
    syllables = "an be co du er fi go hu in jo ka le mi no or pe qu ra si to".split()
    return [("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))) for _ in range(n)]


def edge_rows():
    """Nulls, blanks, ties, repeated rows, near and exact copies, a shared passage, a long text."""
    rng = random.Random(5)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "a"), (4, "a b"), (5, "A  B"), (6, "a b c d"), (6, "a b c d"), (7, None), (None, None), (None, "a b c d")]
    passage = " ".join(prose(rng, 90))
    base = prose(rng, 120)
    for i in range(10, 26):
        w = list(base)
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = "edited" + str(rng.randrange(1000))
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(prose(rng, 30)) + " " + passage + " " + " ".join(prose(rng, 40))) for i in range(30, 36)]
    rows += [(i, " ".join(prose(rng, 60)) + ". Émile İx naïve!") for i in range(40, 52)]
    rows += [(60, rows[20][1]), (61, rows[20][1]), (62, rows[-1][1].upper())]
    rows.append((70, " ".join(prose(rng, 30_000))))
    rows.append((71, "x" * 5000))
    return rows


@pytest.fixture(scope="session")
def edges(spark):
    return frame(spark, edge_rows())


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
