import random

import pytest

WORDS = ["the", "a", "of", "alpha", "beta", "gamma", "delta", "river", "stone", "light", "wave", "cloud", "field", "Ünder", "éclair", "naïve", "niño", "house", "green", "seven"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "s", "ing", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text) with nulls, empty, tiny, long, copied, nearly copied and repeated ones."""
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(1, 160))) for i in range(60)]
    long = prose(rng, 9_000)
    rows += [(100, long), (101, None), (102, ""), (103, " \n\t "), (104, "one"), (105, "one two"), (106, "ONE two"), (107, "x" * 4_000), (None, rows[3][1]), (None, None)]
    for k in range(8):  # near copies of a document
        words = rows[7][1].split(" ") * 3
        words[rng.randrange(len(words))] = f"edit{k}"
        rows.append((200 + k, " ".join(words)))
    rows += [(300 + k, rows[9][1]) for k in range(5)]  # exact copies
    rows += [(400, "begin " + rows[12][1] + " end"), (401, rows[12][1][10:] + " more"), (402, long[2_000:5_000])]
    rows += [(500, rows[20][1]), (500, rows[20][1]), (500, "another text under the same id, long enough to have some shingles of its own")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus as a table with columns that clash with what operators return."""
    rows = [(d, t, "x", 1, "k", None, float("nan")) for d, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, key string, marks string, score double").repartition(5)
