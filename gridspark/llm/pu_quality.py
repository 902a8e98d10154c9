"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents whose labels all say quality 1; everything else counts as unlabelled web text. A linear
model over measures of the text minimises the non-negative unbiased risk with the logistic loss L(g) = log(1 + exp(-g)):

    risk = prior * mean over positives of L(g)  +  max(0, mean over unlabelled of L(-g) - prior * mean over positives of L(-g))

The class prior is estimated, not given: a first model tells positives from unlabelled text, and the prior is the least
ratio of the unlabelled to the positive share among the highest scores (a positive scores high as often in both, so the
ratio can't fall below the prior, and comes down to it where nothing but positives is left). Labels that say 0 are never used.

Both models are fitted by damped Newton steps over all documents: a pass sums risk, gradient and curvature in each task
(at most ``SIZE`` squared numbers) and by key over tasks; the driver solves a system of ``SIZE`` unknowns. If the bracket
of the risk falls below zero, the step climbs out of it instead, as the non-negative estimator asks. No sample is taken.

Scale: a text is read once, and what is kept of it are ``SIZE`` measures; labels are joined to measures, not to texts. Passes
read the written measures.

Inputs of a score are measures of the text alone. Labels are learnt from the rows that ``held_out`` leaves; the standard
scores of measures come from all texts.

Defined results: a null text is empty and scored like an empty one. A null ``doc_id`` has no label and is held out as the
checksum of an empty text. Rows that repeat a ``doc_id`` are scored one by one. Without trusted positives all scores are 0.5. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import SPACE, id_and_text, slices, texts
from gridspark.storage import write_table

FOLDS = 5
THRESHOLD = 0.3
RIDGE = 1e-4
STEPS = 8
BINS = 1000
LEAST_SHARE = 0.05  # of the positives that a share of highest scores must hold to speak for the prior
SYMBOLS = b"#*$%&|<>"
ENDS = b".,;:?"

MEASURES = (
    "symbols in characters",
    "words with symbols",
    "bars in words",
    "shouted words",
    "exclamation marks",
    "word like the one before",
    "different words",
    "lines met before",
    "letters",
    "digits",
    "stops in words",
    "word length",
    "words",
    "words in lines",
)
SIZE = 2 * len(MEASURES) + 1  # each measure, whether it is over a tenth (or its logarithm squared), and one


def measure(text: bytes) -> list[float]:
    words = text.split()
    n, size = max(len(words), 1), max(len(text.translate(None, SPACE)), 1)
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    count = lambda some: len(text) - len(text.translate(None, some))
    n_symbols = count(SYMBOLS)
    return [
        n_symbols / size,
        sum(w.translate(None, SYMBOLS) != w for w in words) / n if n_symbols else 0.0,
        text.count(b"|") / n,
        sum(w.isupper() for w in words if len(w) > 1) / n,
        text.count(b"!") / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        len(set(words)) / n,
        (len(lines) - len(set(lines))) / max(len(lines), 1),
        sum(w[:1].isalpha() or w[0] > 127 for w in words) / n,
        count(b"0123456789") / size,
        count(ENDS) / n,
        float(np.log1p(size / n)),
        float(np.log1p(len(words))),
        float(np.log1p(len(words) / max(len(lines), 1))),
    ]


def expanded(rows: np.ndarray) -> np.ndarray:
    """Shares also as a flag for a share of a tenth or more; logarithms also squared, so that both ends can count."""
    wide = rows.copy()
    wide[:, :-3] = rows[:, :-3] >= 0.1
    wide[:, -3:] = rows[:, -3:] ** 2
    return np.concatenate([rows, wide, np.ones((len(rows), 1))], axis=1)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([measure(t) for part in slices(batch) for t in texts(part)], np.float64).reshape(-1, len(MEASURES))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, len(MEASURES), dtype=np.int32)), pa.array(rows.reshape(-1), pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "own"])


def measures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, own, held_out, trusted``: the measures of every text, and whether it is a trusted positive."""
    own = id_and_text(docs).mapInArrow(_measure_batches, "doc_id long, own array<double>").withColumn("held_out", held_out(F.col("doc_id")))
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(~held_out(F.col("doc_id")))
    good = given.groupBy("doc_id").agg((F.min("quality") == 1).alias("trusted")).where("trusted")
    return own.join(good, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))


def _sums(table: DataFrame, of) -> np.ndarray:
    """``of(measures, trusted)`` gives a row of numbers for some documents; their sums over all documents."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                rows = batch.column("own").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(MEASURES))
                part = of(rows, batch.column("trusted").to_numpy(zero_copy_only=False).astype(np.float64))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total)], ["k", "x"])

    summed = table.select("own", "trusted").mapInArrow(add, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()
    return np.array([r["x"] for r in sorted(summed)], np.float64)


class Scale:
    """Standard scores of the expanded measures over all documents."""

    def __init__(self, table: DataFrame):
        def moments(rows, trusted):
            x = expanded(rows)
            return np.concatenate([[len(x), trusted.sum()], x.sum(axis=0), (x * x).sum(axis=0), trusted @ x])

        sums = _sums(table, moments)
        self.n, self.positives = (sums[0], sums[1]) if sums.size else (0.0, 0.0)
        total, square, good = sums[2:].reshape(3, SIZE) if sums.size else np.zeros((3, SIZE))
        self.mean = total / max(self.n, 1)
        self.mean[-1] = 0.0
        spread = np.sqrt(np.maximum(square / max(self.n, 1) - self.mean**2, 0))
        self.spread = np.where(spread > 1e-9, spread, np.inf)  # a measure that never changes says nothing
        self.spread[-1] = 1.0
        self.good = (good / max(self.positives, 1) - self.mean) / self.spread

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((expanded(rows) - self.mean) / self.spread, -10, 10)


def sigmoid(g: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(g, -500, 500)))


def loss(g: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, -g)


def fit(table: DataFrame, scale: Scale, prior: float, steps: int = STEPS) -> np.ndarray:
    """Weights of least non-negative unbiased risk, from a level start at the prior."""
    w = np.zeros(SIZE)
    w[-1] = np.log(prior / (1 - prior))
    ridge = np.full(SIZE, RIDGE)
    ridge[-1] = 0.0
    for _ in range(steps):

        def part(rows, trusted, w=w):
            x = scale(rows)
            g = x @ w
            p = sigmoid(g)
            curve = (x * (p * (1 - p))[:, None]).T @ x
            sums = [loss(-g).sum(), trusted @ loss(-g), trusted @ loss(g), *(p @ x), *((trusted * p) @ x), *((trusted * (1 - p)) @ x)]
            return np.concatenate([sums, curve.reshape(-1)])

        got = _sums(table, part)
        unlabelled, as_bad, as_good = got[0] / scale.n, got[1] / scale.positives, got[2] / scale.positives
        down = got[3 : 3 + SIZE] / scale.n
        bad, good = got[3 + SIZE : 3 + 2 * SIZE] / scale.positives, got[3 + 2 * SIZE : 3 + 3 * SIZE] / scale.positives
        bracket = unlabelled - prior * as_bad
        slope = -prior * good + down - prior * bad if bracket >= 0 else prior * bad - down
        step = np.linalg.solve(got[3 + 3 * SIZE :].reshape(SIZE, SIZE) / scale.n + np.diag(ridge + 1e-9), slope + ridge * w)
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def estimate_prior(table: DataFrame, scale: Scale) -> float:
    """The least ratio of unlabelled to positive shares among the highest scores of a model that tells the two apart."""
    w = fit(table, scale, 0.5)

    def histogram(rows, trusted):
        at = np.minimum((sigmoid(scale(rows) @ w) * BINS).astype(np.int64), BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, weights=trusted, minlength=BINS)]).astype(np.float64)

    every, good = _sums(table, histogram).reshape(2, BINS)[:, ::-1].cumsum(axis=1)
    share, of_good = every / scale.n, good / scale.positives
    slack = np.sqrt(np.log(20.0) / (2 * scale.n)) + np.sqrt(np.log(20.0) / (2 * scale.positives))
    able = of_good >= LEAST_SHARE
    best = int(np.argmin(np.where(able, (share + slack) / np.maximum(of_good, 1e-12), np.inf)))
    return float(np.clip(share[best] / of_good[best], 0.01, 0.99))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    table = write_table(measures(docs, labels), "measures")
    scale = Scale(table)
    w = fit(table, scale, estimate_prior(table, scale)) if scale.positives else np.zeros(SIZE)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("own").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(MEASURES))
            s = sigmoid(scale(rows) @ w)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return table.select("doc_id", "own", "held_out").mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
