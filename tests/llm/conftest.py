import pytest

EDGES = [(1, "The cat sat on the mat with password=abc123xyz and mail a.b@c.org today", "x"), (2, "", "y"), (3, None, None),
         (4, "word " * 20000, "x"), (5, "The cat sat on the mat with password=abc123xyz and mail a.b@c.org today", "z"),
         (5, "The cat sat on the mat with password=abc123xyz and mail a.b@c.org today", "z"), (None, "no id here", "q"),
         (7, "é ñ 日本 MIT License \u0000 +1 (988) 555-2485", "x")]


@pytest.fixture()
def edges(spark):
    """Nulls, an empty and a long text, ties, repeated rows, clashing extra columns."""
    return spark.createDataFrame([(i, t, s, 1, "k") for i, t, s in EDGES],
                                 "doc_id long, text string, source string, n long, spans string")
