"""Positive-unlabelled learning: held-out accuracy, the estimated prior, the risk's slope, and odd tables."""

import zlib

import numpy as np
import pytest

from gridspark.llm import pu_quality as Q

GOOD = "the {0} of a plain {1} text goes on with {2} and some other words, as texts do. "
BAD = ("BUY!! NOW!! {0}!! ", "w{0}&&& x{1}*** ", "| {0} | {1} ", "the the the the ")


def planted(n, bad_share, seed):
    draw = np.random.default_rng(seed)
    rows, truth = [], {}
    for i in range(n):
        bad = draw.random() < bad_share
        line = BAD[draw.integers(len(BAD))] if bad else GOOD
        rows.append((i, "".join(line.format(*draw.integers(0, 500, 3)) for _ in range(draw.integers(3, 30)))))
        truth[i] = int(not bad)
    return rows, truth


@pytest.fixture(scope="module")
def learnt(spark):
    rows, truth = planted(1500, 0.3, 7)
    docs = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, trusted string, score double").repartition(4)
    labels = spark.createDataFrame([(i, q) for i, q in truth.items() if i % 3 == 0], "doc_id long, quality int")
    return docs, labels, truth


def test_held_out_accuracy_without_labels_of_bad_texts(spark, learnt):
    docs, labels, truth = learnt
    rows = Q.quality_scores(docs, labels).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r.predicted == truth[r.doc_id] for r in rows if r.held_out]
    assert np.mean(held) > 0.97
    only_good = Q.quality_scores(docs, labels.where("quality = 1")).collect()
    assert {r.doc_id: r.score for r in only_good} == pytest.approx({r.doc_id: r.score for r in rows}, abs=1e-6)


def test_labels_of_held_out_rows_change_nothing(spark, learnt):
    docs, labels, _ = learnt
    before = {r.doc_id: r.score for r in Q.quality_scores(docs, labels).collect()}
    turned = labels.withColumn("quality", Q.F.when(Q.held_out(Q.F.col("doc_id")), 1 - Q.F.col("quality")).otherwise(Q.F.col("quality")))
    assert {r.doc_id: r.score for r in Q.quality_scores(docs, turned).collect()} == pytest.approx(before, abs=1e-6)


def test_prior_is_near_the_share_of_good_texts(spark, learnt):
    docs, labels, truth = learnt
    table = Q.measures(docs, labels).persist()
    assert Q.estimate_prior(table, Q.Scale(table)) == pytest.approx(np.mean(list(truth.values())), abs=0.06)


def test_scores_do_not_depend_on_identifiers_or_other_columns(spark, learnt):
    docs, labels, _ = learnt
    text = docs.first().text
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(10_000, text), (10_003, text), (None, text)], "doc_id long, text string"))
    assert len({round(r.score, 9) for r in Q.quality_scores(more, labels).collect() if r.doc_id in (10_000, 10_003, None)}) == 1


def test_the_fit_is_a_least_of_the_risk(spark, learnt):
    docs, labels, _ = learnt
    table = Q.measures(docs, labels).persist()
    scale = Q.Scale(table)
    rows = table.select("own", "trusted").collect()
    x, good = scale(np.array([r.own for r in rows])), np.array([r.trusted for r in rows])
    prior = 0.6

    def risk(w):
        g = x @ w
        return prior * Q.loss(g[good]).mean() + max(0.0, Q.loss(-g).mean() - prior * Q.loss(-g[good]).mean()) + 0.5 * Q.RIDGE * (w[:-1] ** 2).sum()

    w = Q.fit(table, scale, prior, steps=40)
    draw = np.random.default_rng(1)
    assert all(risk(w) <= risk(w + 0.05 * draw.normal(size=w.size)) + 1e-9 for _ in range(50))


def test_odd_rows(spark, learnt, empty, twice):
    docs, labels, _ = learnt
    assert Q.quality_scores(empty, labels).count() == 0
    assert Q.quality_scores(twice, labels).count() == twice.count()
    none = labels.where("false")
    assert {r.score for r in Q.quality_scores(twice, none).collect()} == {0.5}
    long = spark.createDataFrame([(1, "word " * 200_000), (2, None), (3, ""), (4, "z" * 500_000), (6, " \n\t ")], "doc_id long, text string")
    rows = {r.doc_id: r.score for r in Q.quality_scores(docs.select("doc_id", "text").where("doc_id > 10").union(long), labels).collect()}
    assert rows[2] == rows[3] == rows[6] and all(np.isfinite(list(rows.values())))
    both = labels.union(labels.selectExpr("doc_id", "0")).union(spark.createDataFrame([(None, 1), (5, None)], "doc_id long, quality int"))
    assert Q.measures(docs, both).where("trusted").count() == 0
