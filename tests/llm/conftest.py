import pytest


@pytest.fixture
def docs(spark):
    """Documents with null and empty texts, ties, repeated rows, a null id and clashing extra columns."""
    text = "The quick brown fox jumps over the lazy dog again\nA line of more than twenty characters\nshort"
    rows = [(1, text), (2, text), (3, None), (4, ""), (5, "word " * 3000), (6, text + "\nmore"), (6, text + "\nmore"), (None, "no id here"), (7, "A LINE OF MORE than twenty characters  \nÀé ß 東京 <|endoftext|> x՘y")]
    return spark.createDataFrame([(*r, "k", 0.5, 1) for r in rows], "doc_id long, text string, key string, score double, part int")


@pytest.fixture
def none(docs):
    return docs.where("false")
