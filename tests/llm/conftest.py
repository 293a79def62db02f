import pytest

ODD = "doc_id long, text string, lang string, source string, n_chars long, size long, tag string, print long, key int, score double, language string, fingerprint string, leaks int, `of` int, `a.b` int"


@pytest.fixture(scope="session")
def odd(spark):
    """odd(texts, ids=None): documents with columns whose names clash with inner ones, nulls in some of them."""

    def make(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en" if k % 2 else None, f"s{k % 3}" if k % 4 else None, None, 7, "t", None, 1, 0.5, "x", "f", 3, None, 4) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        return spark.createDataFrame(rows, ODD)

    return make


@pytest.fixture(scope="session")
def words():
    """words(n, seed): n made-up words."""
    import random

    def make(n, seed=0):
        rnd = random.Random(seed)
        return [rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") + rnd.choice("bdfgklmnprst") + rnd.choice(["", "an", "or", "is"]) for _ in range(n)]

    return make
