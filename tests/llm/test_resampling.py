"""Importance resampling against plain sums over words."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gridspark.llm import resampling as R
from tests.llm.conftest import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return ws, [zlib.crc32(" ".join(ws[i : i + n]).encode()) % 10_000 for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]


def plain(rows, target, longest=1):
    """Rows of (doc_id, n_features, weight, score, rank); rows of one document may change places in ties."""
    own = [(i, *features(t, longest)) for i, t in rows]
    s = Counter(b for _, _, f in own for b in f)
    t = Counter(b for x in target for b in features(x, longest)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    out = []
    for i, ws, f in own:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(ws)))
    able = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], x[0] is not None, x[0] or 0, x[1], x[2]))
    ranked = [(*x[:4], k) for k, x in enumerate(able[: 10 * len(able) // 100], 1)]
    left = Counter(x[:4] for x in out) - Counter(x[:4] for x in ranked)
    return Counter([*ranked, *[(*x, None) for x in left.elements()]])


def got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


@pytest.fixture(scope="module")
def target(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


@pytest.mark.parametrize("longest", [1, 3])
def test_equals_the_plain_version(spark, sample, documents, target, longest):
    texts = [r.text for r in target.collect()]
    want = plain(sample, texts, longest)
    assert got(R.resample(documents, target, longest=longest)) == want
    assert any(x[4] for x in want) and sum(want.values()) == len(sample)


def test_repeated_rows_and_nulls(spark, twice, target):
    rows = [(r.doc_id, r.text) for r in twice.collect()] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(R.resample(df, target)) == plain(rows, [r.text for r in target.collect()])


def test_empty_tables(spark, empty, documents, sample, target):
    assert R.resample(empty, target).count() == 0
    none = spark.createDataFrame([(1, None)], "item_id long, text string")
    assert got(R.resample(documents, none)) == plain(sample, [])
    few = spark.createDataFrame([(1, "too few words")], "doc_id long, text string")
    assert [r["rank"] for r in R.resample(few, target).collect()] == [None]


def test_bit_slices_are_exact():
    draw = np.random.default_rng(5)
    for gain in (draw.integers(-30_000, 30_000, 10_000), np.zeros(10_000, np.int64), np.full(10_000, -1), np.full(130, 7)):
        docs = [draw.integers(0, len(gain), n) for n in (0, 1, 17, 5_000)] + [np.full(1_025, 3)]
        assert R.weigh(docs, *R.gain_planes(gain)).tolist() == [int(gain[d].sum()) for d in docs]


def test_a_long_text_without_spaces(spark, target):
    df = spark.createDataFrame([(1, "x" * 300_000 + "é"), (2, "a, " * 100_000)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_features) for r in R.resample(df, target).collect()) == [(1, 1), (2, 100_000)]
