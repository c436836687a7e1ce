import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, and a column with a clashing name."""
    import random

    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
    base = text(60)
    near = base.split()
    near[30] = "changed"
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "en", "b"), (4, None, None, None), (5, "", "en", "a"), (6, " \n\t", None, "b"), (7, text(20_000), "de", "a"), (8, "Short text", "en", None), (9, "é ü 漢字", "fr", "b"), (9, "é ü 漢字", "fr", "b"), (None, text(30), "en", "a"), (10, "12 34", "en", "a")]
    rows += [(100 + i, text(40), "en" if i % 2 else "de", "c") for i in range(20)]
    return spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, source string, key string, n double")
