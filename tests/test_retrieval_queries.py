"""The registered retrieval queries search with whole benchmark texts."""

from suite import fact

SF = "/root/testdata/sf0.001"


def test_queries_are_whole_texts(spark):
    want = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    assert any("." in t.rstrip(" .") for t in want.values())
    assert {r.query_id: r.query for r in fact.query_view(spark, SF).collect()} == want
