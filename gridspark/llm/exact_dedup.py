"""Exact dedup: tree-merge of sorted digest runs.

Every input partition makes one run: its distinct digests, sorted, each with its smallest identifier and its
number of rows. In each round ``FAN`` neighbouring runs are exchanged and merged into one; a merge keeps the
smallest identifier of equal digests. The digests of one run are dealt over all tasks, so that no task ever
holds a whole run, and the last run (the whole corpus) is as spread out as the first ones.

A copy is believed only if SHA-256, the length in bytes and an independent 64-bit hash of the texts all agree;
that test is part of the key of every merge.

Defined results: a null text is an empty one. A null identifier counts as larger than any other. Rows that repeat
an identifier are rows like others (they count in ``group_size``); exactly one row of a group has ``kept``. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import SPACE_RUN, id_and_text, packed
from gridspark.storage import write_table

FAN = 16
KEY = ["digest", "n_bytes", "check"]


def normalised(text):
    return F.regexp_replace(text, SPACE_RUN, " ")


def digests(docs: DataFrame) -> DataFrame:
    """``(doc_id, row, run, digest, n_bytes, check)``: one row per document, one run per input partition."""
    norm = id_and_text(docs).select("doc_id", normalised(F.col("text")).alias("_t"))
    return norm.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        F.spark_partition_id().alias("run"),
        F.unhex(F.sha2("_t", 256)).alias("digest"),
        F.octet_length("_t").alias("n_bytes"),
        F.xxhash64("_t").alias("check"),
    )


def merge_runs(keyed: DataFrame, fan: int = FAN) -> DataFrame:
    """``(digest, n_bytes, check, keep, group_size)`` after the last round; ``keep`` is a struct that ends in (doc_id, row)."""
    run_count = (keyed.agg(F.max("run")).first()[0] or 0) + 1
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    # a struct as the aggregate's buffer makes Spark merge sorted runs: sort by (run, digest), then one pass
    merged = keyed.groupBy("run", *KEY).agg(F.min(first).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    while run_count > 1:
        merged = (
            merged.withColumn("run", F.floor(F.col("run") / fan).cast("int"))
            .groupBy("run", *KEY)
            .agg(F.min("keep").alias("keep"), F.sum("group_size").alias("group_size"))
        )
        run_count = -(-run_count // fan)
    return merged.drop("run")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    keyed = write_table(digests(docs), "digests")
    groups = merge_runs(keyed)
    return keyed.join(groups, KEY).select(  # a large group is one row on the right; adaptive execution splits its left side
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that also share the identifier, one."""
    firsts = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("_keep"), F.unhex("text_sha256").alias("_digest"))
    rows = packed(docs, _id=F.col("doc_id").cast("long"), _hash=F.unhex(F.sha2(normalised(F.coalesce(F.col("text"), F.lit(""))), 256)))
    own = F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_hash") == F.col("_digest"))
    again = Window.partitionBy("_id", "_hash").orderBy("_id")
    return rows.join(firsts, own, "left_semi").withColumn("_n", F.row_number().over(again)).where("_n = 1").select("_row.*")
