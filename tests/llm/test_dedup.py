from itertools import combinations

import numpy as np
import pytest

from gridspark.llm import simhash, substrings
from gridspark.llm.exact_dedup import drop_exact_copies, exact_dedup, merge_runs
from gridspark.llm.simhash import drop_near_copies, near_dedup
from gridspark.llm.substrings import cut_repeats, repeated_windows, substring_dedup
from tests.llm import brute


def test_exact_matches_brute_force(documents, sample):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(documents).collect()}
    assert got == brute.exact(sample)


def test_exact_merge_takes_several_rounds(spark):
    df = spark.range(0, 4000, 1, 40).selectExpr("id doc_id", "cast(id % 7 as string) text")
    from gridspark.llm.exact_dedup import digests
    from gridspark.storage import write_table

    groups = merge_runs(write_table(digests(df)), fan=3).collect()
    assert sorted(r.keep.doc_id for r in groups) == list(range(7)) and sum(r.group_size for r in groups) == 4000


def test_exact_repeated_rows_and_null_ids(twice):
    rows = exact_dedup(twice).collect()
    of = [r for r in rows if r.group_size == 4]
    assert len(of) == 4 and sum(r.kept for r in of) == 1 and {r.keep_id for r in of} == {1}
    assert sorted(str(r.doc_id) for r in drop_exact_copies(twice).collect()) == ["1", "1", "2", "None"]


def test_exact_stage_keeps_columns(documents, sample):
    out = drop_exact_copies(documents)
    assert out.columns == documents.columns
    assert {r.doc_id for r in out.collect()} == {i for i, x in brute.exact(sample).items() if x[2]}


def test_triples_reach_every_four_positions():
    triples = simhash.byte_triples()
    assert len(set(triples)) == 20
    assert all(any(set(t) <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_near_matches_brute_force(documents, sample):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_dedup(documents).collect()}
    assert got == brute.near(sample)


@pytest.mark.parametrize("limit", [2, 100, simhash.LIST])
def test_near_links_of_a_dense_group(spark, limit):
    rng = np.random.default_rng(5)
    center = int(rng.integers(0, 2**63))
    marks = {center}
    for _ in range(400):
        m = center
        for b in rng.choice(64, rng.integers(0, 7), replace=False):
            m ^= 1 << int(b)
        marks.add(m)
    marks |= {int(x) for x in rng.integers(0, 2**63, 100)}
    marks = sorted(marks)
    df = spark.createDataFrame([(int(np.uint64(m).astype(np.int64)),) for m in marks], "mark long")
    links = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in simhash.near_links(df, limit=limit).collect()]
    assert all(0 < (a ^ b).bit_count() <= 4 for a, b in links)

    def parts(edges):
        parent = {m: m for m in marks}

        def find(v):
            while parent[v] != v:
                v = parent[v]
            return v

        for a, b in edges:
            parent[find(a)] = find(b)
        groups = {}
        for m in marks:
            groups.setdefault(find(m), set()).add(m)
        return {frozenset(g) for g in groups.values()}

    assert parts(links) == parts([(a, b) for a, b in combinations(marks, 2) if (a ^ b).bit_count() <= 4])


def test_near_repeated_rows_and_stage(twice, documents, sample):
    rows = near_dedup(twice).collect()
    assert len(rows) == 7 and {r.component_id for r in rows if r.doc_id is None and r.fingerprint == "0" * 16} == {None}
    out = drop_near_copies(documents)
    assert out.columns == documents.columns
    assert {r.doc_id for r in out.collect()} == {i for i, (_, c) in brute.near(sample).items() if c == i}


@pytest.mark.parametrize("size", [1, 5, 13, 20])
def test_substrings_match_brute_force(documents, sample, size):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(documents, size).collect()}
    assert got == brute.substrings(sample, size)


def test_substrings_with_many_small_tasks(documents, sample, monkeypatch):
    monkeypatch.setattr(substrings, "TOGETHER", 2000)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(documents.repartition(40)).collect()}
    assert got == brute.substrings(sample)


def test_levels():
    assert substrings.lengths(13) == [7, 13] and substrings.lengths(50) == [7, 13, 25, 50]


def test_substrings_repeated_rows_and_null_ids(twice):
    rows = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substring_dedup(twice).collect())
    assert rows == [("1", 3, 0), ("1", 40, 0), ("1", 40, 0), ("2", 41, 40), ("None", 0, 0), ("None", 40, 40), ("None", 40, 40)]


def test_substring_stage_keeps_rows_and_layout(spark):
    first = " ".join(f"w{i}" for i in range(20))
    rows = [(1, first, 7, "a"), (2, f"head\n\n{first}\n  tail", 8, "b"), (3, first, 9, None), (4, None, None, "d")]
    out = cut_repeats(spark.createDataFrame(rows, "doc_id long, text string, n_chars int, cuts string")).collect()
    assert {tuple(r) for r in out} == {(1, first, 7, "a"), (2, "head\n  tail", 11, "b"), (3, "", 0, None), (4, None, None, "d")}


@pytest.mark.parametrize("operator", [exact_dedup, near_dedup, substring_dedup, drop_exact_copies, drop_near_copies, cut_repeats, repeated_windows])
def test_empty_table(empty, operator):
    assert operator(empty).collect() == []
