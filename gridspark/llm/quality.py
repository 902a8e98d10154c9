"""Quality rules by weak supervision.

Every rule looks at a document's counts and votes good (+1), bad (-1) or abstains (0). Expectation-maximisation
estimates from the votes alone how often each rule is right on good and on bad documents, and how many documents
are good; a document is kept if its posterior probability of being good reaches ``KEEP``. No single rule rejects
a document; only the base test of the contract (too few words, too much repetition) does.

Scale: a document's votes are one of at most 3^rules patterns. One pass over the documents counts patterns
(map-side combined), the driver fits the model on that bounded histogram, which holds all documents, and the
posterior goes back as one row per pattern.

Defined results: a null text has no words and fails the base test. Words are maximal runs without 0x20 and
0x09-0x0D. Repeated rows give repeated rows. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import SPACE, id_and_text, slices, texts
from gridspark.storage import write_table

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
KEEP = 0.5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts", "n_bangs", "n_lettered", "n_marked")
COUNTS_SCHEMA = ", ".join(f"{c} long" for c in COUNTS)


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that occur at least twice in the text. Exact: windows are compared by
    numbers that are equal only for equal words (word numbers, then numbers of pairs of numbers)."""
    count = len(words)
    if count <= size:
        return 0
    number: dict[bytes, int] = {}
    word = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, count)
    window, width = word, 1
    while width < size:
        step = min(width, size - width)  # the second part may overlap the first: both together still name the window
        _, window = np.unique(window[: count - width - step + 1] * np.int64(count) + window[step : count - width + 1], return_inverse=True)
        width += step
    again = np.bincount(window)[window] > 1
    edge = np.zeros(count + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def counts(text: bytes) -> tuple[int, ...]:
    """The numbers named in ``COUNTS`` for one whole text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    plain = text.translate(None, SYMBOLS)
    n_symbols = len(text) - len(plain)
    return (
        len(words),
        len(text.translate(None, SPACE).decode("utf-8", "replace")),
        n_symbols,
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        sum(w.isupper() for w in words if len(w) > 1),
        text.count(b"!"),
        len([w for w in words if w[:1].isalpha() or w[0] > 127]),
        len([w for w in words if w.translate(None, SYMBOLS) != w]) if n_symbols else 0,
    )


@dataclass(frozen=True)
class Rule:
    """Votes good up to ``good``, bad from ``bad`` on, and abstains between; abstains on documents without words."""

    name: str
    measure: Callable[[dict[str, np.ndarray]], np.ndarray]
    good: float
    bad: float

    def votes(self, c: dict[str, np.ndarray]) -> np.ndarray:
        x = self.measure(c)
        vote = np.where(x <= self.good, 1, np.where(x >= self.bad, -1, 0))
        return np.where(c["n_words"] > 0, vote, 0).astype(np.int64)


def _per(name: str, base: str) -> Callable[[dict[str, np.ndarray]], np.ndarray]:
    return lambda c: c[name] / np.maximum(c[base], 1)


#: Faults show in more than one measure, so that agreement between rules can tell a fault from a harmless oddity.
RULES = (
    Rule("symbols per word", _per("n_symbols", "n_words"), 0.02, 0.10),
    Rule("symbols among characters", _per("n_symbols", "word_chars"), 0.005, 0.03),
    Rule("words with symbols", _per("n_marked", "n_words"), 0.02, 0.10),
    Rule("capitals", _per("n_shouts", "n_words"), 0.10, 0.30),
    Rule("exclamation marks", _per("n_bangs", "n_words"), 0.05, 0.20),
    Rule("no letters", lambda c: 1.0 - c["n_lettered"] / np.maximum(c["n_words"], 1), 0.10, 0.25),
    Rule("same lines", _per("n_dup_lines", "n_lines"), 0.05, 0.25),
    Rule("repetition", _per("n_repeat_words", "n_words"), 0.05, 0.20),
    Rule("word length", lambda c: np.abs(np.log(np.maximum(c["word_chars"], 1) / np.maximum(c["n_words"], 1) / 5.0)), np.log(2.0), np.log(3.0)),
)
PLACES = 3 ** np.arange(len(RULES), dtype=np.int64)


def patterns(c: dict[str, np.ndarray]) -> np.ndarray:
    """The votes of all rules as one number in base three."""
    return sum(((r.votes(c) + 1) * p for r, p in zip(RULES, PLACES, strict=True)), np.zeros(len(c["n_words"]), np.int64))


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])


@dataclass(frozen=True)
class Model:
    """``share``: of good documents; ``good`` and ``bad``: per rule, how often a vote is right on such documents."""

    share: float
    good: np.ndarray
    bad: np.ndarray

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        vote = (np.asarray(pattern)[:, None] // PLACES) % 3 - 1
        up, down = (vote > 0).astype(float), (vote < 0).astype(float)
        yes = np.log(self.share) + up @ np.log(self.good) + down @ np.log(1 - self.good)
        no = np.log(1 - self.share) + up @ np.log(1 - self.bad) + down @ np.log(self.bad)
        return 1.0 / (1.0 + np.exp(np.clip(no - yes, -700, 700)))


def fit(pattern: np.ndarray, n: np.ndarray, rounds: int = 500, tolerance: float = 1e-9) -> Model:
    """Expectation-maximisation over the histogram of vote patterns.

    Starts from rules that seldom blame a good document and find some of the bad ones (a bad document mostly has
    one fault, which only some of the rules see). Rates are Beta estimates around that start, and a rule blames
    bad documents at least twice as often as good ones, so that the classes cannot change places.
    """
    k = len(RULES)
    model = Model(0.9, np.full(k, 0.97), np.full(k, 0.3))
    vote = (np.asarray(pattern)[:, None] // PLACES) % 3 - 1
    up, down = vote > 0, vote < 0
    for _ in range(rounds if len(n) else 0):
        p = model.posterior(pattern)
        yes, no = p * n, (1 - p) * n
        rate = lambda hit, miss, a, b, least: np.clip((hit + a) / (hit + miss + a + b), least, 0.999)
        good = rate(yes @ up, yes @ down, 97.0, 3.0, 0.5)
        bad = rate(no @ down, no @ up, 3.0, 7.0, np.minimum(0.9, 2 * (1 - good)))
        share = float(np.clip((yes.sum() + 9.0) / (n.sum() + 10.0), 0.01, 0.99))
        moved = max(abs(share - model.share), np.abs(good - model.good).max(), np.abs(bad - model.bad).max())
        model = Model(share, good, bad)
        if moved < tolerance:
            break
    return model


def _table(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    rows = np.array([counts(t) for part in slices(batch) for t in texts(part)], np.int64).reshape(-1, len(COUNTS))
    return {name: rows[:, i] for i, name in enumerate(COUNTS)}


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = _table(batch)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c[x]) for x in COUNTS), pa.array(patterns(c))], ["doc_id", *COUNTS, "pattern"])


def document_counts(docs: DataFrame) -> DataFrame:
    """``doc_id``, the columns of ``COUNTS`` and the vote ``pattern``."""
    return id_and_text(docs).mapInArrow(_count_batches, f"doc_id long, {COUNTS_SCHEMA}, pattern long")


def fit_patterns(counted: DataFrame) -> tuple[Model, np.ndarray, np.ndarray]:
    """Fit on the pattern histogram of all documents: at most 3^rules rows reach the driver."""
    rows = sorted(counted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect())
    pattern, n = np.array([r["pattern"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.float64)
    model = fit(pattern, n)
    return model, pattern, model.posterior(pattern) if len(rows) else np.zeros(0)


def quality(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, the base counts, ``base_failed``, ``posterior`` and ``kept``."""
    counted = write_table(document_counts(docs), "counts")
    _, pattern, posterior = fit_patterns(counted)
    spark = docs.sparkSession
    judged = spark.createDataFrame([(int(a), float(b)) for a, b in zip(pattern, posterior, strict=True)], "pattern long, posterior double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = counted.join(F.broadcast(judged), "pattern")  # at most 3^rules rows
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged. The counts are taken again where the rows are, so no text is shuffled."""
    _, pattern, posterior = fit_patterns(document_counts(docs))
    good = np.sort(pattern[posterior >= KEEP])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = _table(batch)
            yield batch.filter(pa.array(~base_failed(c) & np.isin(patterns(c), good)))

    return docs.mapInArrow(keep, docs.schema)
