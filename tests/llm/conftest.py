import pytest


@pytest.fixture(scope="session")
def vocabulary():
    from cloudstrata.llm.queries import vocabulary

    return vocabulary()


@pytest.fixture
def docs_of(spark):
    """documents of texts, with ids from 0, and an extra column whose name an operator uses itself."""

    def make(texts, ids=None):
        rows = [(None if i is None else int(i), t, "en", "src0", None if t is None else len(t), "extra") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")

    return make
