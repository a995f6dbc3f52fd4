from __future__ import annotations

import random

import pytest


@pytest.fixture(scope="session")
def words():
    r = random.Random(4)
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(600)]


@pytest.fixture
def docs(spark):
    """A documents table of (id, text) rows; a column may clash with names that operators make."""

    def make(rows, partitions=3):
        full = [(i, t, "en", f"s{(i or 0) % 3}", len(t) if t is not None else None, i) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, kept long").repartition(partitions)

    return make


@pytest.fixture
def odd_texts():
    """Null and empty texts, white space, a repeated row, a null id, a very long text."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "no id here"), (5, "long words " * 60_000), (6, "Ümläut ИМЯ 漢字 ½ 🙂\nline\n\nline")]
