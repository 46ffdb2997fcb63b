import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int, words=("river", "stone", "of", "the", "and", "light", "carry", "seven", "in", "window", "paper", "salt", "to", "bridge")):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + (str(rng.randrange(60)) if rng.random() < 0.4 else "") for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    def build(rows):
        return spark.createDataFrame([(*r, None)[:5] if len(r) == 4 else r for r in rows], SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, repeated rows, line ends of all kinds."""
    long = prose(1, 30_000)
    return [
        (1, None, "en", "a", 0), (2, "", None, None, None), (None, prose(2, 80), "en", "a", 1), (None, None, None, None, None),
        (3, long, "en", "b", len(long)), (4, prose(3, 90), "fr", "b", 1), (4, prose(3, 90), "fr", "b", 1),
        (5, " \t\n ", "en", "c", 4), (6, "a\x0bb\x0cc\rd    é 𓀀", "de", "c", 1), (7, "word " * 3000, "en", "a", 1),
    ]


@pytest.fixture(scope="session")
def clashing(spark, docs, odd_rows):
    """The odd rows with further columns named like results and intermediate columns."""
    names = ("size", "taken", "kept", "base", "spans", "score", "ids", "rank", "key", "cls", "n", "licences", "copies", "bucket")
    frame = docs(odd_rows)
    for i, name in enumerate(names):
        frame = frame.selectExpr("*", f"'{name}' AS `{name}`" if i % 2 else f"{i} AS `{name}`")
    return frame
