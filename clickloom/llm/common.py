"""What the operators share: tables, the shared folder, and connected components."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_made: dict[str, list[tuple]] = {}
_own: dict[str, str] = {}
_shipped: set[str] = set()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one where that is unset and the master is local, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own[spark.sparkContext.applicationId] = f"file://{tempfile.mkdtemp(prefix='clickloom-')}"
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/clickloom/{name}-{uuid.uuid4().hex}"
    remember(spark, path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remember(spark: SparkSession, path: str) -> None:
    """Have cleanup() remove a path, at the latest when the driver ends, also after the session has been stopped."""
    owner = spark.sparkContext.applicationId
    if owner not in _made:
        _made[owner] = []
        atexit.register(_clear, owner)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _made[owner].append((where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())))


def _clear(owner: str) -> None:
    for where, files in _made.pop(owner, []):
        with contextlib.suppress(Exception):  # the driver's JVM may have ended before
            files.delete(where, True)


def cleanup(spark: SparkSession) -> None:
    """Remove the tables that this session's operators wrote into the shared folder; call it once their results are used."""
    _clear(spark.sparkContext.applicationId)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application: they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="clickloom-")  # the driver serves it as long as the application lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))


def without(docs: DataFrame, *names: str) -> DataFrame:
    """docs without columns that an operator is about to add: its own replace those of the input."""
    taken = {n.lower() for n in names}
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken))


def bound_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches that Python workers get small whatever the length of the texts."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def gather(batches, text: str, size: int = 2 << 20):
    """Join small Arrow batches into ones of about ``size`` bytes of text: numpy calls cost little per row then."""
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.column(text).nbytes
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def parallelism(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def inner(docs: DataFrame) -> str:
    """A beginning for names of inner columns that no column of docs has."""
    found = "__"
    while any(c.lower().startswith(found) for c in docs.columns):
        found += "_"
    return found


def split_by_keys(docs: DataFrame, key, keys: DataFrame, bits: int = 23) -> tuple[DataFrame, DataFrame]:
    """docs in two parts: rows whose key (an integer expression) may be in the only column of keys, and the others. A null key never is.

    A bitmap of 2**bits bits (at most 2**(bits - 6) rows, so its broadcast is bounded) is looked up by a hash of the key. It keeps
    most texts out of the exchange of a join that follows; where it is too small for the keys it only says "may be" more often.
    """
    p, words = inner(docs), 1 << (bits - 6)

    def place(key):
        h = F.xxhash64(key.cast("long"))
        return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(words - 1)), h.bitwiseAND(F.lit(63)).cast("int")

    own = F.col(keys.columns[0])
    word, bit = place(own)
    table = keys.where(own.isNotNull()).select(word.alias(f"{p}word"), bit.alias(f"{p}bit"))
    table = materialize(table.groupBy(f"{p}word").agg(F.bit_or(F.expr(f"shiftleft(1L, {p}bit)")).alias(f"{p}bits")), "bitmap")
    word, bit = place(key)
    marked = docs.withColumns({f"{p}word": word, f"{p}bit": bit, f"{p}some": key.isNotNull()}).join(F.broadcast(table), f"{p}word", "left")
    maybe = F.col(f"{p}some") & F.coalesce(F.expr(f"shiftrightunsigned({p}bits, {p}bit)").bitwiseAND(F.lit(1)) == 1, F.lit(False))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return marked.where(maybe).select(*columns), marked.where(~maybe).select(*columns)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected graph of edges (a, b), as rows (id, component).

    component is the smallest id reachable; only nodes with edges get a row. Each level hooks every node to its smallest
    neighbour (a partially aggregated minimum, so a hub is no hot spot), follows hooks to the roots by doubling, and
    replaces the edges by those between different roots, which shrink fast. Every step is a written table, and edges should be one; only
    whether something changed comes to the driver.
    """
    edges = edges.where("a <> b")
    done: list[DataFrame] = []
    while True:
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("component")), "labels")
        labels = _follow(labels, labels)
        done.append(labels)
        at = [labels.select(F.col("id").alias(c), F.col("component").alias(f"{c}_root")) for c in ("a", "b")]
        left = edges.join(at[0], "a").join(at[1], "b").where("a_root <> b_root")
        edges = materialize(left.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            break
    labels = done.pop()
    while done:  # the roots of a level are the nodes of the next
        lower = done.pop()
        up = labels.select(F.col("id").alias("component"), F.col("component").alias("top"))
        labels = lower.join(up, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
        labels = materialize(labels, "labels")
    return labels


def _follow(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """Replace each label by its own label until nothing changes."""
    while True:
        seen = Observation()
        up = roots.select(F.col("id").alias("component"), F.col("component").alias("top"))
        jumped = labels.join(up, "component").select("id", F.col("top").alias("component"), (F.col("top") != F.col("component")).alias("moved"))
        labels = roots = materialize(jumped.observe(seen, F.count_if("moved").alias("n")), "labels").select("id", "component")
        if not seen.get["n"]:
            return labels


class Forest:
    """Union-find over 0..n-1 inside one task; the smaller index is the root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def roots(self):
        import numpy as np

        return np.array([self.find(x) for x in range(len(self.parent))], dtype=np.int64)
