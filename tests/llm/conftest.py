"""Edge cases shared by the operator tests."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of ``(doc_id, text)`` or ``(doc_id, text, lang)``, with columns whose names the operators use inside."""

    def make(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, None, "x", 1, [7], b"y") for r in rows]
        return spark.createDataFrame(
            full, DOCS + ", id string, key long, lines array<int>, row binary"
        )

    return make


@pytest.fixture(scope="session")
def edges(docs_of):
    """NULLs, empty and blank texts, repeated rows, ties, a long text."""
    long = " ".join(f"word{i % 977}" for i in range(40_000))
    return docs_of(
        (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (None, "one two"), (None, None), (5, "one  two\r\n"),
        (6, long), (7, "é ü ß 日本 😀"), (8, "One line here now.\nOne line here now.\n"), (9, "1234 5678 !!"),
    )
