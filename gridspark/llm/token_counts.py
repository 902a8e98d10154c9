"""Token counts as an exact histogram of document lengths.

Every batch of documents is encoded and at once reduced to (length, documents), which Spark sums up: what is shuffled
grows with the number of different lengths, not of documents. Suffix sums over the histogram then answer, for every
context limit, how many documents reach it, how many tokens they hold, what cutting at the limit leaves, and all
quantiles. The sums are taken in two levels (runs of ``RUN`` lengths, then inside a run), so that no window holds the
whole histogram.

Defined results: a null text is an empty one, of length 0. Repeated rows count repeatedly. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import id_and_text
from gridspark.storage import write_table

RUN = 1024


def token_lengths(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``length, n``: partial counts per batch of documents, by the byte-level vocabulary file ``ranks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        with open(ranks, "rb") as f:  # a parameter of the operator: the vocabulary is installed on every executor
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        for batch in batches:
            size, n = np.unique([len(encoding.encode_ordinary(x.as_py())) for x in batch.column("text")], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(size, pa.int64()), pa.array(n, pa.int64())], ["length", "n"])

    return id_and_text(docs).select("text").mapInArrow(run, "length long, n long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per length: ``length, n_docs, docs_from, tokens_from, tokens_cut, docs_to_share``.

    ``docs_from`` and ``tokens_from`` are of documents of at least that length; ``tokens_cut`` is the corpus total if
    every document is cut at that length; ``docs_to_share`` is the share of documents up to that length.
    """
    hist = lengths.groupBy("length").agg(F.sum("n").alias("n_docs")).withColumn("_run", F.floor(F.col("length") / RUN))
    hist = write_table(hist, "lengths")  # read twice below, while the texts are to be encoded once
    sums = [F.sum("n_docs").alias("_d"), F.sum(F.col("n_docs") * F.col("length")).alias("_t")]
    later = Window.orderBy(F.col("_run").desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row per run of lengths
    total = Window.orderBy(F.col("_run").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = hist.groupBy("_run").agg(*sums)
    ends = ends.select(
        "_run",
        *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in ("_d", "_t")],
        *[F.sum(c).over(total).alias(f"{c}_all") for c in ("_d", "_t")],
    )
    inside = Window.partitionBy("_run").orderBy(F.col("length").desc())
    rows = hist.join(ends, "_run").select(
        "length",
        "n_docs",
        (F.col("_d_later") + F.sum("n_docs").over(inside)).alias("docs_from"),
        (F.col("_t_later") + F.sum(F.col("n_docs") * F.col("length")).over(inside)).alias("tokens_from"),
        "_d_all",
        "_t_all",
    )
    return rows.select(
        "length",
        "n_docs",
        "docs_from",
        "tokens_from",
        (F.col("_t_all") - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias("tokens_cut"),
        ((F.col("_d_all") - F.col("docs_from") + F.col("n_docs")) / F.col("_d_all")).alias("docs_to_share"),
    )


def quantiles(histogram: DataFrame, shares: Sequence[float]) -> DataFrame:
    """``share, length``: the least length that at least this share of documents do not exceed."""
    columns = [F.min(F.when(F.col("docs_to_share") >= s, F.col("length"))).alias(f"_{i}") for i, s in enumerate(shares)]
    found = histogram.agg(*columns)
    return found.select(F.inline(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"_{i}").alias("length")) for i, s in enumerate(shares)])))


def cut_totals(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """``limit, tokens, docs_cut``: tokens left and documents shortened if every document is cut at ``limit``."""
    at = lambda k: F.when(F.col("length") > k, F.lit(k)).otherwise(F.col("length")) * F.col("n_docs")
    columns = [c for i, k in enumerate(limits) for c in (F.sum(at(k)).alias(f"_t{i}"), F.sum(F.when(F.col("length") > k, F.col("n_docs")).otherwise(0)).alias(f"_d{i}"))]
    found = histogram.agg(*columns)
    rows = [F.struct(F.lit(int(k)).alias("limit"), F.col(f"_t{i}").alias("tokens"), F.col(f"_d{i}").alias("docs_cut")) for i, k in enumerate(limits)]
    return found.select(F.inline(F.array(*rows)))
