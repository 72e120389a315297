import pytest

TEXTS = [
    None, "", "   ", "\n\n", "one", "two words", "the quick brown fox jumps over the lazy dog again and again until the very end of the day comes",
    "the quick brown fox jumps over the lazy dog again and again until the very end of the day comes", "x" * 60_000, ("long text of words " * 4000).strip(), "café ÉTÉ naïve 日本語 🙂", "tab\tand\x0bother\x0cspaces\r\nline two\nline two\n",
    "mail a.b@c.example.com call (212) 555-0175 card 4111111111111111 at 10.0.0.1 token = \"abcdef0123456789abcdef0123456789\"",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and extra columns with clashing names."""
    rows = [(i, t, "en" if i % 2 else None, "s", 0, "x", 1.0, 2) for i, t in enumerate(TEXTS)]
    rows += [rows[6], rows[6], (None, TEXTS[6], "en", "s", 0, "x", 1.0, 2), (6, "another text with the same id as one before", "de", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, batch int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(13)] + [(3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
