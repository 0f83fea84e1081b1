import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, copies and near copies."""
    base = " ".join(f"w{i}" for i in range(200))
    near = base.replace("w199", "changed")
    far = " ".join(f"v{i}" for i in range(200))
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "b"),
        (3, near, "en", "a"),
        (4, far, None, None),
        (5, None, "en", "a"),
        (6, "", "de", "b"),
        (7, " \n\t ", "de", "c"),
        (8, "one two", "de", "c"),
        (9, "one two", "de", "c"),
        (9, "one two", "de", "c"),
        (20, "x" * 50_000 + " y", "fr", "a"),
        (40, "é ß 漢字 " * 3000, "fr", "a"),
        (None, "lost words here", "fr", "a"),
        (11, "password=abcdefghijkl0123 token: 'shortone' AKIA0123456789ABCD 0123456789abcdef Password = \"ZZZZZZZZZZZZZ\"", "en", "b"),
    ]
    return make(spark, rows)


@pytest.fixture(scope="session")
def none(spark):
    return make(spark, [])


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 1, 0), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
