import pytest

#: Rows that every operator on texts has to stand: nulls, empty and long texts, ties, repeats, odd characters.
EDGE_TEXTS = [None, "", " ", "\n\n", "a", "word " * 3000, "x" * 5000, "Ünïcödé 日本 \U0001F600 tail",
              "one two three four five six seven eight nine ten eleven twelve",
              "one two three four five six seven eight nine ten eleven twelve"]


@pytest.fixture
def edge_docs(spark):
    """Documents with null ids and columns whose names clash with those used inside."""
    rows = [(i if i != 3 else None, t, "en" if i % 2 else None, i) for i, t in enumerate(EDGE_TEXTS)]
    rows += [(8, EDGE_TEXTS[8], None, 1), (2 ** 60 + 1, "big id", None, 2)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, id string, n_words int")


@pytest.fixture
def no_docs(edge_docs):
    return edge_docs.filter("false")
