import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Make a documents table from (doc_id, text[, lang[, source]]) tuples."""
    def make(rows, extra=()):
        full = [(r[0], r[1], *(list(r[2:]) + [None, None])[:2], None if r[1] is None else len(r[1]), *([7] * len(extra))) for r in rows]
        return spark.createDataFrame(full, DOC_SCHEMA + "".join(f", {c} int" for c in extra))
    return make


# Names that the operators use inside; a table that brings them must not be disturbed.
CLASHES = ("length", "start", "node", "ids", "key", "block", "score", "kept", "_h", "_salt", "_host", "_block", "_rank", "_p", "_id", "_text")
