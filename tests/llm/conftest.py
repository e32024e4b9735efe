import pytest

PASSAGE = "The old mill stood by the river. Its wheel had not turned for a hundred years and more. Children said that a ghost lived in the loft. Nobody ever went to look for it. In spring the water rose to the door and left mud on the floor."


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows and extra columns with clashing names."""
    long_word = "x" * 150_000
    long_text = " ".join(f"w{i % 977}q{i}" for i in range(30_000))
    rows = [
        (1, "", "en", "a"), (2, None, "en", "a"), (None, "some words without an id here", None, None), (3, long_word, "en", None),
        (4, long_text, None, "b"), (5, long_text, "de", "b"), (6, "one two", "de", "b"), (7, "one two", "de", "b"), (7, "one two", "de", "b"),
        (7, "another text of the same id", "de", "b"), (8, " \t\n\r\x0b\x0c ", "de", "b"), (9, "a\x00b  <s> é漢字😀 ▁▁ " + PASSAGE, "fr", "c"),
        (10, "Before it. " + PASSAGE + " After it.", "fr", "c"), (11, "dup line\ndup line\n\nother | $ # line\ndup line", "fr", "c"),
        (12, "A b C d E f. " * 40, "fr", "c"), (13, "a " * 5000, "fr", "c"), (14, PASSAGE, "en", "a"), (15, PASSAGE.replace("mill", "barn"), "en", "a"),
    ]
    more = [(i, t, lang, s, len(t or ""), i, 1, 2, "x", 3, 4, 5) for i, t, lang, s in rows]
    return spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long, node long, n long, part int, span string, places int, hash int, cell long").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
