"""Rows without an identifier, or with a repeated one, take up their own positions only."""

import pytest

from gridspark.llm import substrings
from tests.llm import brute


@pytest.mark.parametrize("ident", [None, 7])
def test_first_level_tells_rows_apart(spark, monkeypatch, ident):
    shared = " ".join(f"s{i}" for i in range(30))
    rows = [(ident, f"{shared} " + " ".join(f"w{k}x{i}" for i in range(20))) for k in range(25)] + [(1, shared)]
    tables, write = [], substrings.write_table
    monkeypatch.setattr(substrings, "write_table", lambda df, name: tables.append(write(df, name)) or tables[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id is not None and r.doc_id, r.n_words, r.n_removed) for r in substrings.substring_dedup(docs).collect())
    want = brute.substrings([(100, rows[0][1]), (1, shared)])[100][1]
    assert want == 30 and got == sorted([(ident or False, 50, want)] * 25 + [(1, 30, 0)])
    first = [t for t in tables if "doc" in t.columns][0]
    assert first.select("doc").distinct().count() == 26
