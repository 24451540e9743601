"""Placement of vertices as they arrive, on Structured Streaming.

Each micro-batch of (ord, v, nets) is placed by ``place_batch`` on the connectivity that the ones before left, which is
kept as tables in the shared folder, a folder for each batch: a restart goes on from the last whole batch.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinweave.functions.expressions import capacity
from pinweave.model import check_parts
from pinweave.operators.place import TOUCHED, arrivals, check_policy, new_connections, place_batch
from pinweave.store import exists, folder

#: The sizes of the parts, the K * K connections (for ``tm``) as packed bits, and the policy they belong to.
STATE = "sizes array<bigint>, connected binary, policy string"
ARRIVALS = "ord bigint, v bigint, nets array<struct<net:bigint,src:bigint>>"


class StreamPlacer:
    """Call as ``foreachBatch`` function; ``parts()`` is everything placed so far.

    Each batch appends its own files: the placed vertices, the connectivity they add and, last, the sizes of the parts.
    A batch counts once the sizes are there, so a placer made anew on the same folder goes on after the last whole
    batch, and a batch that is run again is skipped or writes the same files again.
    """

    def __init__(self, spark: SparkSession, nov: int, k: int, policy: str = "tv", path: str | None = None):
        check_parts(k)
        check_policy(policy)
        self.spark, self.k, self.policy = spark, k, policy
        self.limit, self.path = capacity(nov, k), path or folder(spark)
        self.sizes, self.last, self.connected = [0] * k, -1, np.zeros((k, k), dtype=bool)
        if exists(spark, f"{self.path}/sizes"):
            row = spark.read.schema(f"{STATE}, epoch bigint").parquet(f"{self.path}/sizes").agg(F.max(F.struct("epoch", "sizes", "connected", "policy")).alias("last")).first()["last"]
            if row is not None:
                if (row["policy"] or policy) != policy or len(row["sizes"]) != k:
                    raise ValueError(f"{self.path} holds a placement in {len(row['sizes'])} parts by {row['policy']!r}")
                self.last, self.sizes = row["epoch"], list(row["sizes"])
                if row["connected"] is not None:
                    self.connected = np.unpackbits(np.frombuffer(row["connected"], np.uint8), count=k * k).reshape(k, k).astype(bool)

    def _read(self, name: str, schema: str) -> DataFrame:
        if self.last < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, epoch bigint").parquet(f"{self.path}/{name}").where(F.col("epoch") <= self.last).drop("epoch")

    def _write(self, rows: DataFrame, name: str, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/epoch={epoch}")

    def parts(self) -> DataFrame:
        return self._read("parts", "v bigint, part int")

    def touched(self) -> DataFrame:
        return self._read("touched", TOUCHED)

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        if epoch <= self.last:
            return
        placed, sizes = place_batch(batch, self.touched(), self.sizes, self.limit, self.policy, self.connected)
        self._write(placed, "parts", epoch)
        placed = self.spark.read.schema("v bigint, part int").parquet(f"{self.path}/parts/epoch={epoch}")
        before = self.touched()
        self._write(arrivals(batch, placed), "touched", epoch)
        connected = self.connected
        if self.policy == "tm":
            connected = connected | new_connections(before, self.spark.read.schema(TOUCHED).parquet(f"{self.path}/touched/epoch={epoch}"), self.k)
        bits = bytearray(np.packbits(connected).tobytes()) if self.policy == "tm" else None
        self._write(self.spark.createDataFrame([(sizes, bits, self.policy)], STATE).coalesce(1), "sizes", epoch)
        self.sizes, self.connected, self.last = sizes, connected, epoch


def place_stream(source: str, nov: int, k: int, spark: SparkSession, policy: str = "tv", files_per_batch: int = 1, path: str | None = None) -> DataFrame:
    """(v, part) of all vertices in a folder of Parquet files of ARRIVALS, in the order of the files' times.

    With ``path`` state and progress are kept there, and a later call goes on with the files that came since.
    """
    placer = StreamPlacer(spark, nov, k, policy, path)
    stream = spark.readStream.schema(ARRIVALS).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(placer).option("checkpointLocation", f"{placer.path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return placer.parts()


def write_arrivals(rows: DataFrame, path: str, batch: int) -> None:
    """(ord, v, nets) as one file for each run of ``batch`` vertices, in order."""
    n = rows.agg(F.max("ord")).first()[0]
    for lo in range(0, 0 if n is None else n + 1, batch):
        rows.where(F.col("ord").between(lo, lo + batch - 1)).coalesce(1).write.mode("append").parquet(path)
