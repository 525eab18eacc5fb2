import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _rank string, quality string"
ODD = [None, "", " \n\t ", "a", "The the THE", "naïve 漢字 🙂  two  spaces\n\nnew\tline", "x" * 3000, "same line here\n" * 40]


@pytest.fixture
def documents(spark):
    """A table of texts with ids from 0, with columns whose names clash with those of operators."""
    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, "en" if t and len(t) % 2 else None, "s", len(t) if t else None, "r", "q") for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, SCHEMA).repartition(3)
    return make


@pytest.fixture
def odd():
    return list(ODD)


@pytest.fixture
def rows():
    def collect(df, key="doc_id"):
        return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key] is not None, r[key], repr(r)))
    return collect
