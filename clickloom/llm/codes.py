"""Vector code compression: product quantisation on whole numbers, with annular norm pruning.

A component x becomes floor(256 x), and a vector is cut into ``parts`` equal consecutive parts. Every position has a codebook of at most
``entries`` entries, which begins as that part of the vectors of smallest id. A round assigns every part to its nearest entry and
replaces an entry by the floored mean of its parts; an entry without parts stays. After the last round parts are assigned again.

The nearest entry is found exactly: entries are sorted by norm, and as | |x| - |c| | <= |x - c|, no entry outside the annulus
|x| - d .. |x| + d of norms can be as near as one found at distance d. d comes from the entry nearest in norm and from its two
neighbours, both ends of the annulus by binary search (inclusively, so that ties go to the lower index), and only the entries
inside are compared, in whole numbers.

Every pass is one map over the written vectors; it sends back the sums of each entry's parts (``parts`` times ``entries`` rows a task,
added up by Spark), so that only codebooks come to the driver and go out again.

Defined cases: vectors that are null, empty or hold null or non-finite components are dropped, and so are those of another dimension than the
first one's, of a dimension that ``parts`` does not divide, or with a component of 2**18 or more (their errors have no place in 64
bits). Rows that share a vec_id are vectors of their own; ids order the first entries, then components; a null id comes last. With fewer vectors than
entries the codebooks are smaller. Null labels are one label. An empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, gather, materialize, read

SCALE = 256
LARGEST = 1 << 26  # of a whole component; the sum of 2^9 squares of differences stays below 2^63


def whole(values: pa.Array, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows that can be used (of dimension dim, or of any single one if that is None), and their components as whole numbers."""
    length = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(length == dim if dim else length > 0)
    if not len(rows):
        return rows, np.empty((0, dim or 0), np.int64)
    x = values.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), -1)  # nulls become NaN
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(x * SCALE)
        fine = (np.abs(x) < LARGEST).all(1)
    return rows[fine], x[fine].astype(np.int64)


class Book:
    """One position's entries, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        norm = np.sqrt((entries * entries).sum(1).astype(float))
        self.at = np.argsort(norm, kind="stable")
        self.norm, self.entries = norm[self.at], entries[self.at]

    def nearest(self, x: np.ndarray, chunk: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row; the lower index among equals."""
        found = [self._nearest(x[k : k + chunk]) for k in range(0, len(x), chunk)]
        return tuple(np.concatenate([*(f[i] for f in found), np.empty(0, np.int64)]) for i in (0, 1))

    def _distance(self, x: np.ndarray, k: np.ndarray) -> np.ndarray:
        d = x - self.entries[k]
        return np.einsum("ij,ij->i", d, d)

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norm = np.sqrt((x * x).sum(1).astype(float))
        near = np.searchsorted(self.norm, norm)
        best = None
        for k in (near - 1, near, near + 1):
            d = self._distance(x, np.clip(k, 0, len(self.norm) - 1))
            best = d if best is None else np.minimum(best, d)
        reach = np.sqrt(best.astype(float))
        slack = 1e-9 * (norm + reach) + 1e-9  # more than the roots' rounding, so that the annulus is closed
        low = np.searchsorted(self.norm, norm - reach - slack, "left")
        high = np.searchsorted(self.norm, norm + reach + slack, "right")
        width = high - low  # at least 1: the entry at distance reach
        row = np.repeat(np.arange(len(x)), width)
        start = np.cumsum(width) - width
        k = np.arange(len(row)) - np.repeat(start - low, width)
        d = self._distance(x[row], k)
        least = np.minimum.reduceat(d, start)
        index = np.where(d == least[row], self.at[k], len(self.at))
        return np.minimum.reduceat(index, start), least


def encode(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (a column for each part) and squared distances of whole-number vectors."""
    width = x.shape[1] // len(books)
    found = [Book(b).nearest(x[:, k * width : (k + 1) * width]) for k, b in enumerate(books)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, codes array<int>, error long) of every kept vector, and the codebooks: an array of entries for each part."""
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))

    def keep(batches):
        for batch in gather(batches, "embedding"):
            length = pc.list_value_length(batch.column("embedding"))
            for dim in pc.unique(length).drop_null().to_pylist():
                if dim and dim % parts == 0:
                    at, x = whole(batch.column("embedding"), dim)
                    offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * dim)
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), batch.column("label").take(pa.array(at)), pa.ListArray.from_arrays(offsets, pa.array(x.ravel(), pa.int64()))], names=["vec_id", "label", "x"])

    kind = rows.schema["label"].dataType.simpleString()
    kept = materialize(rows.mapInArrow(keep, f"vec_id long, label {kind}, x array<long>"), "whole-vectors")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(1).collect()
    if not first:
        return kept.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")), []
    dim = len(first[0].x)
    kept = kept.where(F.size("x") == dim)
    seeds = np.array([r.x for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()], np.int64)  # entries rows
    width = dim // parts
    books = [seeds[:, k * width : (k + 1) * width].copy() for k in range(parts)]
    for _ in range(rounds):
        books = _moved(kept, books)
    sent = spark.sparkContext.broadcast(books)  # parts * entries rows

    def assign(batches):
        for batch in gather(batches, "x"):
            codes, error = encode(batch.column("x").flatten().to_numpy().reshape(-1, dim), sent.value)
            offsets = pa.array(np.arange(len(codes) + 1, dtype=np.int32) * parts)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.ListArray.from_arrays(offsets, pa.array(codes.ravel().astype(np.int32))), pa.array(error.sum(1))], names=["vec_id", "label", "codes", "error"])

    return kept.mapInArrow(assign, f"vec_id long, label {kind}, codes array<int>, error long"), books


def _moved(kept: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after a round: floored means of what is nearest to each entry."""
    dim, (n, width) = sum(b.shape[1] for b in books), books[0].shape
    sent = kept.sparkSession.sparkContext.broadcast(books)

    def sums(batches):
        count, total = np.zeros((len(books), n), np.int64), np.zeros((len(books), n, width), np.int64)
        for batch in gather(batches, "x"):
            x = batch.column("x").flatten().to_numpy().reshape(-1, dim)
            codes, _ = encode(x, sent.value)
            for k in range(len(books)):
                count[k] += np.bincount(codes[:, k], minlength=n)
                np.add.at(total[k], codes[:, k], x[:, k * width : (k + 1) * width])
        part, entry = np.nonzero(count)
        part, entry, place = (np.repeat(part, width), np.repeat(entry, width), np.tile(np.arange(width), len(part)))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (part, entry, place, count[part, entry], total[part, entry, place])], names=["part", "entry", "place", "n", "total"])

    added = kept.mapInArrow(sums, "part long, entry long, place long, n long, total long").groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = [b.copy() for b in books]
    for r in added.collect():  # a row for each component of the codebooks
        out[r.part][r.entry, r.place] = r.total // r.n
    return out


def op12_vector_codes(spark, sf_dir):
    """Every kept vector with its code, its error and that of its label, and a digest of the codebooks."""
    coded, books = compress(read(spark, sf_dir, "embeddings"))
    text = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    coded = materialize(coded.select("vec_id", "label", text.alias("code"), "error"), "codes")
    # the sums are a table of their own, so that Spark knows their size and can split a label that many rows share
    sums = materialize(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """The same in SQL: one common table expression for each step."""
    steps = [
        "ok AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS x FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS (SELECT vec_id, label, k, x[k * (len(x) // {parts}) + 1 : (k + 1) * (len(x) // {parts})] AS v FROM ok, (SELECT unnest(range({parts})) AS k))",
        f"b0 AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS e, v AS c FROM p WHERE vec_id IN (SELECT vec_id FROM ok ORDER BY vec_id LIMIT {entries}))",
    ]
    for r in range(rounds + 1):
        distance = "list_sum(list_transform(list_zip(p.v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        steps.append(f"d{r} AS MATERIALIZED (SELECT p.vec_id, p.label, p.k, p.v, b.e, CAST({distance} AS BIGINT) AS d FROM p JOIN b{r} AS b USING (k))")
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, label, k, any_value(v) AS v, min(d) AS d, min_by(e, d * {entries} + e) AS e FROM d{r} GROUP BY vec_id, label, k)")
        if r < rounds:
            steps.append(
                f"m{r} AS (SELECT k, e, list(m ORDER BY i) AS c FROM (SELECT k, e, i, CAST(floor_div AS BIGINT) AS m FROM (SELECT k, e, i, CASE WHEN s >= 0 OR s % n = 0 THEN s // n ELSE s // n - 1 END AS floor_div FROM "
                f"(SELECT k, e, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, 513)) AS i) WHERE i <= len(v) GROUP BY k, e, i))) GROUP BY k, e)"
            )
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.k, b.e, coalesce(m.c, b.c) AS c FROM b{r} AS b LEFT JOIN m{r} AS m USING (k, e))")
    return (
        f"WITH {', '.join(steps)}, rows_ AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY k) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label) "
        "SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, "
        f"(SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY k, e)) FROM b{rounds}) AS codebooks_sha256 FROM rows_"
    )


OP12_SQL = _sql()
