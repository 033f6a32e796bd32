import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # Names that the operators use themselves.
    "row long, score double, fp long, part int, copy int, shuffle_key string, size long, block int, component long, content long, terms string"
)
EXTRA = (7, 0.5, 3, 1, 9, "k", 4, 2, 8, 6, "t")


def make(spark, rows):
    """``documents`` with clashing extra columns from (doc_id, text, lang, source)."""
    data = [(i, t, lang, s, None if t is None else len(t), *EXTRA) for i, t, lang, s in rows]
    return spark.createDataFrame(data, SCHEMA)


PLAIN = "The first of these lines is about the weather. It was raining on the hills and in the valley all day long. "
ODD = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \n\t ", None, None),
    (4, PLAIN, "en", "b"),
    (4, PLAIN, "en", "b"),
    (5, PLAIN, "en", "b"),
    (None, PLAIN + "More.", None, "b"),
    (None, None, None, None),
    (6, "12345 !!! ???", "en", "a"),
    (7, "x", "en", "a"),
    (8, " ".join(f"word{i}" for i in range(30_000)), "en", "c"),
    (9, "ä" * 150_000, "de", "c"),
    (10, "the the the the the the the the the the the the the the the", "en", "a"),
]


@pytest.fixture(scope="session")
def docs(spark):
    return make(spark, ODD)


@pytest.fixture(scope="session")
def no_docs(spark):
    return make(spark, [])
