"""Sinks: appended tables, and keyed stores for micro-batches.

A keyed store is a folder of Parquet in which every micro-batch writes its rows under its own epoch. Writing an epoch again replaces
it, so a replayed batch changes nothing, and a batch writes its own rows only, however large the store is. What a row means is decided on
reading: additive counts are summed over epochs, replaced values come from a key's last epoch, replaced groups are the rows of a
group's last epoch. compact() folds epochs into one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_jdbc(rows: DataFrame, url: str, table: str, properties: dict[str, str], batch_size: int = 1000) -> None:
    """Append to a JDBC table, in batches of rows and one transaction a partition; Spark opens and closes the connections."""
    rows.write.option("batchsize", batch_size).jdbc(url, table, mode="append", properties=properties)


@dataclass(frozen=True)
class EpochStore:
    """A keyed store at a path."""

    spark: SparkSession
    path: str
    schema: str

    def write(self, rows: DataFrame, epoch: int) -> None:
        """Replace an epoch; its rows lie by date where the store has one, so that readers of some days skip the others."""
        writer = rows.write.mode("overwrite")
        (writer.partitionBy("date") if self.dated else writer).parquet(f"{self.path}/epoch={epoch}")

    @property
    def dated(self) -> bool:
        return self.schema.startswith("date ")

    def rows(self) -> DataFrame:
        """Everything written, with its epoch; no rows if nothing was."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], f"{self.schema}, epoch long")
        return self.spark.read.schema(f"{self.schema}, epoch long").parquet(self.path)

    def summed(self, keys: list[str], value: str, before: int | None = None) -> DataFrame:
        """Additive reading: the sum of a value by key, of epochs before one if given."""
        rows = self.rows() if before is None else self.rows().where(F.col("epoch") < before)
        return rows.groupBy(*keys).agg(F.sum(value).alias(value))

    def latest(self, keys: list[str], value: str) -> DataFrame:
        """Replacing reading: the value of each key's last epoch."""
        return self.rows().groupBy(*keys).agg(F.max_by(value, "epoch").alias(value))

    def latest_groups(self, keys: list[str]) -> DataFrame:
        """Group-replacing reading: the rows of each group's last epoch."""
        rows = self.rows()
        last = rows.groupBy(*keys).agg(F.max("epoch").alias("__last"))
        return rows.join(last, keys).where(F.col("epoch") == F.col("__last")).drop("__last", "epoch")

    def compact(self, keys: list[str], value: str, target: str) -> EpochStore:
        """A new store that holds the sums so far as one epoch."""
        store = EpochStore(self.spark, target, self.schema)
        top = self.rows().agg(F.coalesce(F.max("epoch"), F.lit(0)).alias("e")).first().e
        store.write(self.summed(keys, value), int(top))
        return store
