"""The pipeline against plain versions of its stages, each on the rows that the stage before it kept."""

import pytest

import corpus_pipeline
from gridspark.llm.quality import quality
from gridspark.llm.substrings import _without
from tests.llm import brute
from tests.llm.test_near_copies import kept, shingles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF).persist()
        out[name] = (before, docs)
    return out


def rows_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_order_and_columns(stages):
    assert list(stages) == ["quality rules", "exact dedup", "SimHash near-dedup", "substring dedup", "best-fit packing"]
    for before, after in list(stages.values())[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage(stages):
    before, after = stages["quality rules"]
    assert rows_of(after).keys() == {r.doc_id for r in quality(before).where("kept").collect()}
    before, after = stages["exact dedup"]
    assert rows_of(after).keys() == {i for i, x in brute.exact(rows_of(before).items()).items() if x[2]}
    before, after = stages["SimHash near-dedup"]
    assert rows_of(after).keys() == kept({i: shingles(t) for i, t in rows_of(before).items()})
    before, after = stages["substring dedup"]
    old, new = rows_of(before), rows_of(after)
    want = brute.substrings(old.items())
    import hashlib

    for i, text in new.items():
        assert hashlib.sha256(" ".join(brute.words(text)).encode()).hexdigest() == want[i][2]
        assert want[i][1] or text == old[i]
    assert all(r.n_chars == len(r.text) for r in after.collect())
    before, after = stages["best-fit packing"]
    rows = after.collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == brute.pieces(rows_of(before).items())
    brute.check_sequences(rows)


def test_run_is_the_stages(spark, stages):
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, stages["best-fit packing"][1].collect()))


def test_cutting_keeps_the_layout():
    assert _without(b"a b\n\nc  d e", [(1, 1)], 2) == "a  d e"
    assert _without(b" a b c ", [(0, 1)], 3) == ""
    assert _without(b" a b c d ", [(0, 1)], 2) == "c d "
