import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text, lang, source) tuples, with a clashing extra column."""

    def make(rows, parts=3):
        full = [(r[0], r[1], *(r[2:] or ("en", "src")), len(r[1] or ""), k, "x") for k, r in enumerate(rows)]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, key long, value string").repartition(parts)

    return make


#: Texts that every operator must stand: null, empty, blank, very long, repeated, odd signs.
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "word " * 30_000), (5, "same text of some words here"), (5, "same text of some words here"),
    (6, "same text of some words here"), (None, "no id at all"), (7, "😀 ▁ é\x00z"), (8, "x"), (9, "a" * 50_000), (7, "another text with that id"),
]


@pytest.fixture(scope="session")
def awkward(frame):
    return frame([(i, t, "en" if k % 3 else None, "src1" if k % 2 else None) for k, (i, t) in enumerate(AWKWARD)])


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.where("false")
