"""Snapshot stores: keyed tables for micro-batches that stay cheap to read however many batches there were.

A batch writes its own rows as a segment of level 0 and commits a manifest, a small file that names all segments which make up the store after
that batch. When ``fanout`` segments of a level have come together they are folded into one of the next level, so after n batches there
are at most (fanout - 1) * log_fanout(n) segments and every row is rewritten log_fanout(n) times. Readers take one manifest and read what
it names and nothing else: a fixed snapshot, without listing data folders, whatever is written or folded meanwhile.

A batch that is run again replaces its own segment as long as it is the last one; an earlier one was whole when its successor was
written and is left alone. Manifests are moved into place in one step. The newest ``keep`` manifests and what they name stay, so a reader has that many
batches of time; what only older ones name is removed.

What folding means is the store's kind:

- ``sum``: the value columns are added by key;
- ``last``: a key's row of the last epoch replaces earlier ones (with no other column than keys: a set);
- ``groups``: all rows of a group's last epoch replace its earlier rows.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("sum", "last", "groups")


@dataclass(frozen=True)
class SnapshotStore:
    """A keyed store at a path; schema: the columns of its rows as DDL, keys: those that tell rows (or groups) apart."""

    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]
    kind: str = "sum"
    fanout: int = 8
    keep: int = 4

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}")

    # writing

    def write(self, rows: DataFrame, epoch: int) -> None:
        """Commit a batch; one that is repeated changes nothing."""
        epochs = self._epochs()
        if epochs and epochs[-1] > epoch:
            return
        segments = self._manifest(max((e for e in epochs if e < epoch), default=None))
        columns = [f.name for f in self._fields()]
        segments = self._folded([*segments, self._segment(rows.select(*columns, F.lit(epoch).cast("long").alias("epoch")), 0, epoch, epoch)])
        self._commit(epoch, segments)
        self._clean([*(e for e in epochs if e != epoch), epoch])

    def _segment(self, rows: DataFrame, level: int, first: int, last: int) -> dict:
        name = f"{first}-{last}-{uuid.uuid4().hex[:12]}"
        # rows of a file lie by key: readers of some days skip the others by the files' own statistics
        rows.sortWithinPartitions(*self.keys).write.parquet(f"{self.path}/data/{name}")
        return {"name": name, "level": level, "first": first, "last": last}

    def _folded(self, segments: list[dict]) -> list[dict]:
        level = 0
        while any(s["level"] >= level for s in segments):
            own = [s for s in segments if s["level"] == level]
            if len(own) >= self.fanout:
                new = self._segment(self._fold(self._read(own)), level + 1, own[0]["first"], own[-1]["last"])
                segments = sorted([*(s for s in segments if s not in own), new], key=lambda s: s["first"])
            level += 1
        return segments

    # reading

    def snapshot(self, epoch: int | None = None) -> DataFrame:
        """The store's rows as they are after the last batch, or after the last one up to epoch, without the column epoch."""
        return self._fold(self.rows(epoch)).drop("epoch")

    def rows(self, epoch: int | None = None) -> DataFrame:
        """The rows of that snapshot's segments, not folded, with the last epoch of each."""
        return self._read(self._manifest(max((e for e in self._epochs() if epoch is None or e <= epoch), default=None)))

    def delta(self, epoch: int) -> DataFrame:
        """The rows of one batch, while it has a segment of its own."""
        found = [s for s in self._manifest(epoch) if s["first"] == s["last"] == epoch]
        if not found and epoch not in self._epochs():
            raise ValueError(f"no manifest of epoch {epoch}")
        return self._read(found)

    def segments(self) -> list[dict]:
        """Name, level, first and last epoch of what the newest manifest names."""
        return self._manifest(max(self._epochs(), default=None))

    def _fields(self) -> list[T.StructField]:
        return T.StructType.fromDDL(self.schema).fields

    def _read(self, segments: list[dict]) -> DataFrame:
        schema = f"{self.schema}, epoch long"
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{s['name']}" for s in segments))

    def _fold(self, rows: DataFrame) -> DataFrame:
        columns = [f.name for f in self._fields()]
        values = [c for c in columns if c not in self.keys]
        last = F.max("epoch").alias("epoch")
        if self.kind == "sum":
            return rows.groupBy(*self.keys).agg(*(F.sum(c).alias(c) for c in values), last).select(*columns, "epoch")
        if self.kind == "last":
            if not values:
                return rows.groupBy(*self.keys).agg(last).select(*columns, "epoch")
            newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "epoch").alias("v"), last)
            return newest.select(*(F.col(f"v.{c}").alias(c) if c in values else F.col(c) for c in columns), "epoch")
        # a group holds its rows of a few epochs: those of the snapshot's segments
        return rows.withColumn("__last", F.max("epoch").over(W.partitionBy(*self.keys))).where("epoch = __last").drop("__last")

    # manifests

    def _hadoop(self, *parts: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _epochs(self) -> list[int]:
        """Epochs that have a manifest, in order: keep of them, and one more while a batch commits."""
        where, files = self._hadoop("manifests")
        if not files.exists(where):
            return []
        return sorted(int(s.getPath().getName()) for s in files.listStatus(where) if s.getPath().getName().isdigit())

    def _manifest(self, epoch: int | None) -> list[dict]:
        if epoch is None:
            return []
        where, files = self._hadoop("manifests", str(epoch))
        stream = files.open(where)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, epoch: int, segments: list[dict]) -> None:
        temporary, files = self._hadoop("manifests", f"{epoch}-{uuid.uuid4().hex}.tmp")
        stream = files.create(temporary, True)
        try:
            stream.write(json.dumps(segments).encode())
        finally:
            stream.close()
        where, _ = self._hadoop("manifests", str(epoch))
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()) if where.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(temporary, where, options)

    def _clean(self, epochs: list[int]) -> None:
        """Remove manifests beyond the newest keep, and segments that no other names."""
        epochs = sorted(epochs)
        for e in epochs[: -self.keep]:
            where, files = self._hadoop("manifests", str(e))
            files.delete(where, False)
        named = {s["name"] for e in epochs[-self.keep :] for s in self._manifest(e)}
        where, files = self._hadoop("data")
        for s in files.listStatus(where):  # the named ones and what has just been folded
            if s.getPath().getName() not in named:
                files.delete(s.getPath(), True)
