"""Tables for the tests of the corpus operators."""

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """A table like `documents` from (doc_id, text, source) tuples, with columns whose names could clash."""

    def make(rows):
        rows = [(*r, None)[:3] if len(r) < 3 else r for r in rows]
        rows = [(r[0], r[1], "en", r[2], None if r[1] is None else len(r[1]), r[0], "x") for r in rows]
        return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, words string")

    return make
