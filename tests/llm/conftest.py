import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n string, key string, comp string, line_hash string, segment string, y string, held_out string"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    words = [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    return "".join(w + ("\n" if k % 9 == 8 else " ") for k, w in enumerate(words)).strip()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty and blank texts, a long one, exact and near copies, repeated rows, null ids, clashing column names."""
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    texts = [
        (1, base), (2, base), (3, near), (4, prose(2, 120)), (5, ""), (6, None), (7, " \n\t "), (8, "One two"), (9, "one TWO"), (9, "another text under the same id"),
        (10, prose(3, 20_000)), (None, prose(4, 60)), (None, None), (11, "É ß 日本語 \x00 \x1c tab\there"), (12, prose(5, 60)), (12, prose(5, 60)), (13, "a " * 300), (14, "$$$ ### %%%"),
    ]
    rows = [(i, t, "en" if k % 3 else ("fr" if k else None), f"s{k % 4}" if k % 5 else None, 0, "x", "x", "x", "x", "x", "x", "x") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, (k // 2) % 2, "x") for k in range(1, 14)] + [(None, 1, 1, "x"), (3, None, None, "x"), (3, 0, 0, "x")], "doc_id bigint, quality int, toxic int, text string")
