from __future__ import annotations

import pytest


@pytest.fixture
def documents(spark):
    """Make a documents table, with a column that clashes with names used inside."""

    def make(rows):
        full = [(i, t, "en", "src", len(t or ""), "x", 7) for i, t in rows]
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, line string, component bigint"
        return spark.createDataFrame(full, schema)

    return make
