"""Importance resampling towards a target distribution, with bit-sliced weights.

A text's features are its runs of words, hashed to ``BUCKETS`` buckets. The gain of a bucket says how much more often it is
met in the target texts than in the corpus. A document's weight is the mean gain of its features; with seeded Gumbel noise
added, the highest scores are a draw without replacement in proportion to the importance weights.

Bit-sliced aggregation: a document's bucket counts become planes of ``BUCKETS`` bits (plane p holds bit p of every count),
the gains become planes in two's complement. The AND of a count plane and a gain plane, its ones counted and multiplied by
the power of two of both, summed over all pairs of planes, is the exact sum of count times gain; no floating point is used.

Scale: texts are read where they lie, once for the bucket totals (a task emits at most one row a bucket) and once for the
weights; nothing but four numbers a document is written or shuffled. The driver holds ``BUCKETS`` totals, and the counts of
different scores, whole numbers whose span the gains and the noise bound to about a hundred thousand. Only documents at
or above the score that the draw ends at are range partitioned and numbered.

Defined results: a null text has no words. Without features the weight is 0. A null ``doc_id`` is hashed as nothing behind the
seed and counts as smallest in ties; rows that repeat a ``doc_id`` are documents of their own, ties among them going by
features and weight. No target texts: all target counts are 0. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import id_and_text, slices, texts
from gridspark.scope import running_totals
from gridspark.storage import write_table

BUCKETS = 10_000
LONGEST_RUN = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
TOGETHER = 64  # documents whose planes are held at a time

#: Digits, small letters and all bytes of other alphabets stay; the rest of ASCII parts words.
_PARTED = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.lower().translate(_PARTED).split()  # bytes.lower() changes A-Z alone


def buckets(found: list[bytes], longest: int = LONGEST_RUN, size: int = BUCKETS) -> np.ndarray:
    """The bucket of every run of 1 to ``longest`` words, repeats included."""
    parts = [np.fromiter(map(zlib.crc32, found), np.int64, len(found))]
    for n in range(2, min(longest, len(found)) + 1):
        joined = (b" ".join(found[i : i + n]) for i in range(len(found) - n + 1))
        parts.append(np.fromiter(map(zlib.crc32, joined), np.int64, len(found) - n + 1))
    return np.concatenate(parts) % size


def bucket_totals(table: DataFrame, longest: int = LONGEST_RUN, size: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for part in slices(batch):
                for text in texts(part):
                    total += np.bincount(buckets(words(text), longest, size), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(size, np.int64)
    for bucket, n in table.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    size, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = lambda s, t: float((t + 1) * (s_all + size)) / float((s + 1) * (t_all + size))
    return np.array([math.floor(1000 * math.log(ratio(int(s), int(t)))) for s, t in zip(corpus, target, strict=True)], np.int64)


def gain_planes(gain: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Bit planes of signed numbers in two's complement, 64 buckets a word, and what a one in each plane is worth."""
    width = max(int(gain.max(initial=0)).bit_length(), int(~gain.min(initial=0)).bit_length()) + 1
    wide = np.zeros((width, -(-len(gain) // 64) * 64), np.uint8)
    for q in range(width):
        wide[q, : len(gain)] = gain >> q & 1
    worth = [1 << q for q in range(width - 1)] + [-(1 << (width - 1))]
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64), worth


def weigh(found: list[np.ndarray], planes: np.ndarray, worth: list[int]) -> np.ndarray:
    """The sum of gains over the buckets in each array of ``found``."""
    span = planes.shape[1] * 64
    key, n = np.unique(np.concatenate([b + i * span for i, b in enumerate(found)]), return_counts=True)
    out = np.zeros(len(found), np.int64)
    for p in range(int(n.max(initial=0)).bit_length()):
        bits = np.zeros(len(found) * span, np.bool_)
        bits[key[n >> p & 1 > 0]] = True
        plane = np.packbits(bits.reshape(len(found), span), axis=1, bitorder="little").view(np.uint64)
        for q, one in enumerate(worth):
            out += np.bitwise_count(plane & planes[q]).sum(axis=1, dtype=np.int64) * (one << p)
    return out


def weights(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST_RUN) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the floored mean gain of each document's features."""
    planes, worth = gain_planes(gain)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n, total = [], [], []
            for part in slices(batch):
                own = texts(part)
                for low in range(0, len(own), TOGETHER):
                    split = [words(t) for t in own[low : low + TOGETHER]]
                    found = [buckets(w, longest, len(gain)) for w in split]
                    n_words += map(len, split)
                    n += map(len, found)
                    total.append(weigh(found, planes, worth))
            count = np.array(n, np.int64)
            weight = np.concatenate([*total, np.zeros(0, np.int64)]) // np.maximum(count, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(count), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return id_and_text(docs).mapInArrow(rows, "doc_id long, n_words long, n_features long, weight long")


def with_score(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """Gumbel noise from a hash of the identifier: the same draw on every run."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighed.withColumn("score", (F.col("weight") + noise).cast("long"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST_RUN, size: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank``; ``rank`` is null where a document is not drawn."""
    gain = gains(bucket_totals(docs, longest, size), bucket_totals(target, longest, size))
    scored = write_table(with_score(weights(docs, gain, longest), seed), "scores")
    able = F.col("n_words") >= least_words
    by_score = sorted(((r["score"], r["n"]) for r in scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    drawn = percent * sum(n for _, n in by_score) // 100
    cut, above = None, 0
    for score, n in by_score:
        if above >= drawn:
            break
        cut, above = score, above + n
    if cut is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    within = able & (F.col("score") >= cut)
    order = [("score", False), ("doc_id", True), ("n_features", True), ("weight", True)]
    ranked = running_totals(scored.where(within), [], order, F.lit(1)).withColumn("rank", F.when(F.col("_pos") <= drawn, F.col("_pos").cast("long")))
    return ranked.drop("_pos", "_before").unionByName(scored.where(~within).withColumn("rank", F.lit(None).cast("long")))
