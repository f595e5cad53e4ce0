import random

import pytest

WORDS = [a + b + c for a in ("st", "br", "k", "m", "tr", "pl") for b in ("a", "e", "i", "o") for c in ("n", "rt", "ss", "nd", "l", "m", "x")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (rng.choice(".,") if rng.random() < 0.1 else "") for _ in range(n))


def edited(text: str, seed: int, changes: int) -> str:
    rng = random.Random(seed)
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and extra columns with names used inside."""
    long = prose(1, 30_000)
    base = prose(2, 300)
    rows = [
        (None, base), (None, None), (1, None), (2, ""), (3, " \t\n "), (4, base), (4, base), (5, base), (6, edited(base, 3, 6)), (7, "one"), (8, "one two"),
        (9, "x" * 200_000), (10, "1" * 50_000), (11, long), (12, long + " tail"), (13, "Mail a.b@example.com or +1 (555) 123-4567, card 4111 1111 1111 1111 at 10.0.0.1"),
        (14, prose(4, 200)), (14, prose(5, 200)), (15, "\U0001f600 \u00e9\u00e8 <|endoftext|> \x1c\x85 \u2028 a\u0301"), (16, "!!! ??? ###"),
    ]
    extra = "node long, rep long, sig string, block int, bucket string, kind int, key string, name string, start int, score double, cluster string, page_id string, label string, value double"
    data = [(i, t, None, 1, None, 2, "b", None, "k", None, 7, 0.5, None, "p", None, float("nan")) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, " + extra)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
