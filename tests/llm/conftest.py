import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (doc_id, text) pairs, with the other columns filled in."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", None if i is None else f"src{i % 3}", None if t is None else len(t)) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, a very long one, ties and repeated rows."""
    r = random.Random(3)
    words = [f"w{r.randrange(400)}" for _ in range(30_000)]
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, " ".join(words)), (6, "same text here again and again"), (6, "same text here again and again")]
    rows += [(None, "no id at all in this row"), (None, None), (7, "Grüße an alle\nzwei\n\nZWEI "), (8, "😀 smile".encode("utf-16", "surrogatepass").decode("utf-16"))]
    return rows
