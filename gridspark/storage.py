"""Intermediate tables: Parquet in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``. Local masters that leave it unset get a folder of their
own, since driver and executors are one process there; a cluster without the setting is refused.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
    return spark.conf.get("spark.checkpoint.dir")


@contextmanager
def _shuffle_files_end_with_the_write(spark: SparkSession) -> Iterator[None]:
    """What a write shuffles is of no use once its table stands, so Spark may delete it at once."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


def new_folder(spark: SparkSession, name: str = "folder") -> str:
    """A path in the shared folder that nothing lies at yet; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def write_table(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once and return a reader of it: lineage ends here and lost executors cost no rerun.

    The files live until ``drop_table`` or until the driver ends.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    with _shuffle_files_end_with_the_write(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table from ``write_table`` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
