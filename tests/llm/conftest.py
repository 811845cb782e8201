import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns named like the operators' own ones.
CLASH = "score double, component_id bigint, n bigint, body string, class string, key string, size int, start int, shingle string"


@pytest.fixture
def texts(spark):
    """A documents table from {id: text} or [(id, text)], with columns of clashing names."""

    def make(rows, langs=None, sources=None):
        items = list(rows.items()) if isinstance(rows, dict) else list(rows)
        langs, sources = langs or {}, sources or {}
        full = [(i, t, langs.get(i), sources.get(i), len(t or ""), 0.5, 7, 3, "b", "c", "k", 1, 2, "s") for i, t in items]
        return spark.createDataFrame(full, f"{DOCUMENTS}, {CLASH}")

    return make


@pytest.fixture
def cut():
    from filescape.session import cut

    return cut
