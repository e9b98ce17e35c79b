import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, uid long, row_hash long, _bucket int, sha binary, kept boolean, best int, _row_hash long, _key long, _HOST string"


def make(spark, rows, schema=COLUMNS):
    """Documents with extra columns whose names clash with those that operators add."""
    rows = [(i, t, "en", "src", len(t or ""), 1, 2, 3, b"x", None, None, 4, 5, "h")[: len(schema.split(","))] for i, t in rows]
    return spark.createDataFrame(rows, schema).repartition(3)


LONG = "lorem ipsum dolor " * 20_000

#: Nulls, empty, white and very long texts, ties, repeated rows and a repeated id.
EDGES = [(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (4, " \n\t "), (None, "null id text of some words here"), (None, None), (5, LONG), (6, LONG), (7, "One Two three four five six"), (7, "another text under one id"), (8, "é ß 漢字 \U0001f600\nzwei\n\n\nzwei"), (9, "a")]


@pytest.fixture
def edges(spark):
    return make(spark, EDGES)


@pytest.fixture
def empty(spark):
    return make(spark, EDGES).limit(0)
