import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, q_kept string, spans string, score string, rk string, ids string, band string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and long texts, repeats, and columns named as the operators' own."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30000))
    base = " ".join(f"term{i}" for i in range(120))
    texts = [
        (1, base), (2, base), (2, base), (3, base + " more"), (4, None), (5, ""), (6, " \n\t "), (7, long), (8, "one two three"), (None, base), (None, None),
        (9, "a" * 5000), (10, "x " + base + " y"), (11, "Übergröße ÉÀ 漢字 👩‍👩‍👧"), (12, long), (13, "line\nline\nline\n" + base),
    ]
    rows = [(i, t, None if i == 3 else "en", None, None if t is None else len(t), "k", "s", "0.5", "r", "i", "b") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def some_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (8, 0, 1), (None, 0, 1), (7, None, None), (11, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
