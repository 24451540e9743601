"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark deletes a query's shuffle files when the query ends, in place of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``, or where that is unset below the warehouse, which is shared, too."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/pinweave-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended: the cluster's own cleaning takes over
        pass


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


@contextmanager
def _freed(spark: SparkSession) -> Iterator[None]:
    """Queries within leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def settle(df: DataFrame) -> DataFrame:
    """The rows written as Parquet and read again, which cuts the lineage of a loop and survives lost executors.

    Nothing reads the shuffles of the query again, so they go when it ends: a chain of such tables has the disk of one query's.
    """
    path = folder(df.sparkSession)
    with _freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Deletes tables that ``settle`` wrote and that nothing reads any more."""
    for table in tables:
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            _drop(table.sparkSession, path)


def settle_by(df: DataFrame, column: str) -> DataFrame:
    """The same in a folder for each value of a column, so that reading one of them leaves the others alone."""
    path = folder(df.sparkSession)
    df.repartition(column).write.partitionBy(column).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """Tables of a loop: one of a name takes the place of the one before it, which is deleted once the new one is written.

    Only what is read in the same round may build on such a table.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def settle(self, name: str, df: DataFrame) -> DataFrame:
        path = folder(self.spark)
        df.write.option("compression", "zstd").parquet(path)
        before, self.paths[name] = self.paths.get(name), path
        if before:
            self.drop(before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def close(self, *kept: str) -> None:
        """Deletes all but the tables of these names."""
        for name in [n for n in self.paths if n not in kept]:
            self.drop(self.paths.pop(name))
