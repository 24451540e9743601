"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pinweave.store import settle

BALANCE = 1.05


def capacity(nov: int, k: int) -> float:
    """Soft limit of a part's vertices; 0 where there are fewer vertices than parts."""
    return (nov // k) * BALANCE


def penalised(score: Column, size: Column, limit: float) -> Column:
    """A score less its part's load; 0 without capacity, so that the least loaded part is taken."""
    return score * (1 - size / F.lit(limit)) if limit > 0 else F.lit(0.0)


def modulo_part(v: str, k: int) -> Column:
    return F.pmod(F.col(v), F.lit(k)).cast("int")


def skewed_part(v: str, k: int) -> Column:
    """Every fifth vertex in part 0, the others by modulo."""
    return F.when(F.pmod(F.col(v), F.lit(5)) == 0, 0).otherwise(F.pmod(F.col(v), F.lit(k))).cast("int")


def tilted_part(v: str) -> Column:
    """Eight parts: part 0 beyond its capacity, part 1 the smallest, the others alike."""
    m = F.pmod(F.col(v) * 7919, F.lit(1000))
    return F.when(m < 114, 1).when(m < 284, 0).otherwise(2 + m % 6).cast("int")


def improvement(before: Column, after: Column) -> Column:
    """Percent gained; null where there was nothing to gain on."""
    return F.when(before != 0, 100 - after / before * 100)


def running_total(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Adds the sum of value over all rows with smaller keys; keys are distinct.

    The rows are dealt out in ranges of the keys that hold about as many rows each, whatever numbers the keys are; only
    the ranges' sums are summed up in one task.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Settled, as the bounds of ranges come from a sample and must be the same ones for the sums and for the rows.
    dealt = settle(df.repartitionByRange(ranges, key).sortWithinPartitions(key).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = sums.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_before"))
    inner = F.sum(value).over(Window.partitionBy("_range").orderBy(key)) - F.col(value)
    return dealt.withColumn("_inner", inner).join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + F.col("_inner")).cast("bigint")).drop("_range", "_before", "_inner")


def renumbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """Adds the dense rank, from 0, of the distinct keys."""
    return running_total(df.withColumn("_one", F.lit(1)), key, "_one", name).drop("_one")


def with_numbers(df: DataFrame, numbers: DataFrame, key: str) -> DataFrame:
    """df with the number ``n`` of each key in the key's place.

    Numbers in a row take up next to nothing in a file, so that by its size millions of them would be broadcast and held by
    the driver; they are merged in place of that.
    """
    return df.join(numbers.hint("merge"), key).drop(key).withColumnRenamed("n", key)
