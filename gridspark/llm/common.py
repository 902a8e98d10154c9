"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``bytes.split()`` and ``bytes.strip()`` know exactly these characters: 0x20 and 0x09 to 0x0D.
SPACE = b" \t\n\v\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns under fixed names, so that no other column of ``docs`` can clash; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """A text column as UTF-8 bytes; a null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of text each, so that few texts are Python objects at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + size, side="right")))
        yield batch.slice(low, high - low)
        low = high


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """Whole rows in one struct ``_row`` beside named columns, so that joins meet no clashing names."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[c.alias(n) for n, c in more.items()])


def runs(batches: Iterator[pa.RecordBatch], key: str, columns: list[str]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Batches sorted by ``key`` as arrays that end where a key ends: ``(keys, other columns)``.

    Only the rows of the last, unfinished key are carried over to the next batch.
    """
    carry: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        part = [batch.column(c).to_numpy(zero_copy_only=False) for c in (key, *columns)]
        if carry and part[0][0] == part[0][-1] == carry[-1][0][-1]:
            carry.append(part)
            continue
        whole = [np.concatenate(x) for x in zip(*carry, part, strict=True)] if carry else part
        cut = int(np.searchsorted(whole[0], whole[0][-1], side="left"))
        if cut:
            yield whole[0][:cut], [x[:cut] for x in whole[1:]]
        carry = [[x[cut:] for x in whole]]
    if carry:
        whole = [np.concatenate(x) for x in zip(*carry, strict=True)]
        yield whole[0], whole[1:]
