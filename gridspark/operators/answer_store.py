"""Answer store on disk: one folder per hash bucket of the key, upserted bucket by bucket.

A batch reads only the buckets that its keys fall into and writes only those in which something changes; all other files
stay as they are. Each bucket is replaced by one partition of a dynamic overwrite, so a batch that is cut short leaves
every bucket old or new, and repeating it mends the rest.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators.retrieval import store_answers
from gridspark.operators.textaudit import request_key
from gridspark.scope import unsent
from gridspark.storage import drop_table, write_table

BUCKETS = 256


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("cache_id"), F.lit(buckets)).cast("int")


def read_store(spark: SparkSession, path: str) -> DataFrame | None:
    """The entries of a store; None if nothing was ever written there."""
    try:
        return spark.read.parquet(path).drop("bucket")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def upsert(entries: DataFrame, path: str, buckets: int = BUCKETS) -> int:
    """Merge ``entries`` (``cache_id, created_at, answer, ...``) into the store; returns the number of buckets rewritten.

    Of entries with one ``cache_id`` the latest ``created_at`` wins, ties the greater answer, in the batch as against the
    store: order and repetition of batches do not matter. Rows without a key are not stored. The columns must be
    those of the store, and ``buckets`` the same in every call.
    """
    spark = entries.sparkSession
    rest = [c for c in entries.columns if c != "cache_id"]
    latest = lambda df: df.groupBy("bucket", "cache_id").agg(F.max_by(F.struct(*rest), F.struct("created_at", F.coalesce("answer", F.lit("")))).alias("_e")).select("bucket", "cache_id", "_e.*")
    new = write_table(latest(entries.where(F.col("cache_id").isNotNull()).withColumn("bucket", _bucket(buckets))), "batch")
    held = read_store(spark, path)
    if held is not None:
        if set(held.columns) != set(entries.columns):
            raise ValueError(f"the store has the columns {sorted(held.columns)}, the batch {sorted(entries.columns)}")
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most `buckets` numbers
        held = spark.read.parquet(path).where(F.col("bucket").isin(touched)).select("bucket", *entries.columns)
        before = held.select("cache_id", F.struct("created_at", F.coalesce("answer", F.lit(""))).alias("_held"))
        after = F.struct("created_at", F.coalesce("answer", F.lit("")))
        changed = new.join(before, "cache_id", "left").where(F.col("_held").isNull() | (after > F.col("_held")))
        dirty = [r.bucket for r in changed.select("bucket").distinct().collect()]
        merged = latest(held.where(F.col("bucket").isin(dirty)).unionByName(new.where(F.col("bucket").isin(dirty))))
    else:
        dirty = [r.bucket for r in new.select("bucket").distinct().collect()]
        merged = new
    if dirty:
        whole = write_table(merged, "buckets")  # stands apart before any bucket is replaced
        rows = whole.hint("rebalance", "bucket")
        rows.write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
        drop_table(whole)
    drop_table(new)
    return len(dirty)


def batch_entries(answered: DataFrame, packs: DataFrame, created_at: Column) -> DataFrame:
    """Store entries of a batch of ``answer_batch``: what was answered anew and passes the store's own tests.

    ``packs`` gives ``request_id, area, evidence_hash``; ``created_at`` is read from its rows. Answers that came from the
    store are not written again.
    """
    fields = ("answer", "structured_sections", "claim_boundary_notes", "evidence_used", "fallback_used", "missing_artifacts")
    fresh = answered.where(~F.col("cache_hit")).select("request_id", "mode", "language", "question", *fields)
    given = packs.select("request_id", "area", "evidence_hash", created_at.alias("created_at"))
    key = request_key(F.col("area"), F.col("mode"), F.col("language"), F.col("question"), F.col("evidence_hash"))
    return store_answers(fresh.join(unsent(given), "request_id").withColumn("cache_id", key), None)
