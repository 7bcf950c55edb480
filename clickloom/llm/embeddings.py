"""Embedding near-dedup with int8 tile products and exact error bounds.

Every usable vector is scaled to length one in double precision and quantised to int8 with a scale of its own: x = s q + e, and
r = |e| is stored. For two vectors x.y = s t q.p + (s q).f + e.y, so the cosine differs from s t q.p by at most
|s q| r' + r (as |y| = 1), both known for each vector. Tiles of int8 blocks are multiplied (in float32, whose
sums of int8 products are exact up to 2^24, so in slices of at most 1,024 dimensions); only pairs whose product plus bound
reaches the threshold are computed again in double precision from the full vectors.

Vectors are gathered into packs along the nearest of a fixed number of pivots; each pack keeps its centre and largest angle to it, and two
packs are not multiplied when the triangle inequality for angles shows that no pair of them can reach the threshold. Packs in a row form a
super-block of about ``block_bytes``, and a task compares two super-blocks pack by pack: with n vectors of d numbers each vector is sent n d 4 /
block_bytes times, four times at least (so that a small table gives ten tasks). A task sends back the number of links of each
vector and a spanning forest of its links, never the links themselves, so large groups of copies cost a matrix product and not a list of pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do vectors
of different dimension; very large and very small finite components are scaled before norms are taken; every row is a vector of its own, so rows
that share a vec_id link with each other and count each other; rows without a vec_id link like others but name no component; an empty table
gives no rows; a pair at the threshold itself links; extra columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, bound_batches, components, gather, materialize, read

SLICE = 1024  # 127 * 127 * 1024 < 2^24


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scale, |error| and |scaled values| of unit rows; norms are rounded up."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    near = q * scale[:, None]
    up = 1 + 1e-12
    return q, scale, np.linalg.norm(x - near, axis=1) * up + 1e-15, np.linalg.norm(near, axis=1) * up


def product(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows."""
    q, p = q.astype(np.float32), p.astype(np.float32)
    if q.shape[1] <= SLICE:
        return (q @ p.T).astype(np.float64)
    return sum((q[:, k : k + SLICE] @ p[:, k : k + SLICE].T).astype(np.float64) for k in range(0, q.shape[1], SLICE))


def tile(x: np.ndarray, y: np.ndarray, a: tuple, b: tuple, threshold: float, same: bool, rows: int = 512):
    """Index pairs (i, j) with cosine >= threshold, in slices of x. a, b: what quantise() gave."""
    (q, s, r, n), (p, t, u, m) = a, b
    for k in range(0, len(x), rows):
        part = slice(k, k + rows)
        guess = product(q[part], p)
        guess *= s[part, None]
        guess *= t[None, :]
        bound = n[part, None] * u[None, :]
        bound += r[part, None] + 1e-12
        guess += bound
        i, j = np.nonzero(guess >= threshold)
        if same:
            keep = j > i + k
            i, j = i[keep], j[keep]
        for c in range(0, len(i), 1 << 18):  # full precision, in pieces
            di, dj = i[c : c + (1 << 18)] + k, j[c : c + (1 << 18)]
            hit = np.einsum("ij,ij->i", x[di], y[dj]) >= threshold
            yield di[hit], dj[hit]


def pack_exactly(x: np.ndarray) -> bytes:
    """Single precision where that loses nothing, else double; the first byte tells which."""
    half = x.astype(np.float32)
    return b"f" + half.tobytes() if (half == x).all() else b"d" + x.tobytes()


def unpack(blob: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(blob, np.float32 if blob[:1] == b"f" else np.float64, offset=1).astype(np.float64).reshape(-1, dim)


def usable(values: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of this dimension without null, non-finite or only zero components, and their vectors in double precision."""
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(values), dim), False).to_numpy(zero_copy_only=False))
    flat = values.take(pa.array(rows)).flatten().cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)  # nulls become NaN
    fine = np.isfinite(x).all(1) & (x != 0).any(1)
    return rows[fine], x[fine]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component is made 1 first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root (the least index of each vector's tree) after the links (i, j)."""
    a, b = root[i], root[j]
    apart = a != b
    if not apart.any():
        return root
    pairs = np.unique(np.stack([a[apart], b[apart]]), axis=1)
    nodes, at = np.unique(pairs, return_inverse=True)
    forest = Forest(len(nodes))
    for u, v in at.reshape(2, -1).T.tolist():
        forest.union(u, v)
    table = np.arange(len(root))
    table[nodes] = nodes[forest.roots()]
    return table[root]


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding", pack: int = 1024, block_bytes: int = 8 << 20, pivots: int = 64) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    bound_batches(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    # pivots of each dimension: a bounded sample, smallest hashes first; they steer the order only, results do not depend on them
    bases = {}
    for dim in sorted(r[0] for r in rows.select(F.size("embedding").alias("d")).where("d > 0").distinct().collect()):
        some = rows.where(F.size("embedding") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(pivots).toArrow()
        _, base = usable(some.column(0).combine_chunks(), dim)
        bases[dim] = unit(base) if len(base) else np.eye(1, dim)

    def place(batches):
        for batch in gather(batches, "embedding"):
            dims, pivot, x = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            values = batch.column("embedding")
            for dim in pc.unique(pc.list_value_length(values)).drop_null().to_pylist():
                if dim in bases:
                    at, own = usable(values, dim)
                    dims[at] = dim
                    pivot[at] = (unit(own) @ bases[dim].T).argmax(1) if len(own) else 0
                    for k, v in zip(at.tolist(), own, strict=True):
                        x[k] = v.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), pa.array(dims, pa.int32()), pa.array(pivot, pa.int32()), pa.array(x, pa.binary())], names=["row", "vec_id", "dim", "pivot", "x"])

    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    placed = materialize(numbered.mapInArrow(place, "row long, vec_id long, dim int, pivot int, x binary"), "vectors")
    sizes = {(r["dim"], r["pivot"]): r["count"] for r in placed.where("x is not null").groupBy("dim", "pivot").count().collect()}  # a row per pivot
    found = None
    for dim in sorted({d for d, _ in sizes}):
        links = _links(placed.where((F.col("dim") == dim) & F.col("x").isNotNull()), dim, {k: n for (d, k), n in sizes.items() if d == dim}, threshold, pack, block_bytes)
        found = links if found is None else found.unionByName(links)
    named = placed.select("row", "vec_id")
    if found is None:
        return named.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = materialize(found, "vector-links")
    counts = found.where("root is null").groupBy("row").agg(F.sum("n").alias("n_links"))
    groups = components(found.where("root is not null").select(F.col("row").alias("a"), F.col("root").alias("b")))
    named = named.join(counts, "row", "left").join(groups.withColumnRenamed("id", "row"), "row", "left")
    named = named.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "row").alias("component"))
    least = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return named.join(least, "component").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _links(placed: DataFrame, dim: int, sizes: dict[int, int], threshold: float, pack: int, block_bytes: int) -> DataFrame:
    """(row, n, root): n counts links of a vector in a task (root null), or a forest edge to root (n null)."""
    limit = np.arccos(min(max(threshold, -1.0), 1.0))
    # packs of about ``pack`` vectors: a pivot's vectors are dealt by hash, so that a pivot may hold any share of them
    table, n_packs = [], 0
    for k in sorted(sizes):
        deal = -(-sizes[k] // pack)
        table.append((k, n_packs, deal))
        n_packs += deal
    blocks = max(-(-sum(sizes.values()) * dim * 4 // block_bytes), min(4, n_packs))
    table = F.broadcast(placed.sparkSession.createDataFrame(table, "pivot int, first int, deal int"))  # a row per pivot
    dealt = placed.join(table, "pivot").withColumn("pack", F.col("first") + F.pmod(F.xxhash64("row"), F.col("deal")).cast("int"))

    def gather_pack(key, group):
        x = np.frombuffer(b"".join(group.column("x").to_pylist()), np.float64).reshape(-1, dim)
        own = unit(x)
        mean = own.mean(0)
        size = np.linalg.norm(mean)
        centre = mean / size if size > 1e-9 else own[0]
        radius = float(np.arccos(np.clip(own @ centre, -1, 1)).max()) + 1e-7
        columns = [pa.array([key[0].as_py()], pa.int32()), pa.array([group.column("row").to_pylist()], pa.list_(pa.int64())), pa.array([pack_exactly(x)], pa.binary()), pa.array([centre.tobytes()], pa.binary()), pa.array([radius])]
        return pa.Table.from_arrays(columns, names=["pack", "rows", "x", "centre", "radius"])

    packs = materialize(dealt.select("pack", "row", "x").groupBy("pack").applyInArrow(gather_pack, "pack int, rows array<long>, x binary, centre binary, radius double"), "packs")
    own = F.expr(f"pack * {blocks}L div {n_packs}")
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")), lambda i: F.least(i, F.col("block")) * blocks + F.greatest(i, F.col("block")))
    sent = packs.withColumn("block", own).withColumn("tile", F.explode(tiles))

    def meet(key, group):
        lo, hi = divmod(key[0].as_py(), blocks)
        held = []
        start = 0
        for k in np.argsort(group.column("pack").to_numpy()).tolist():
            x = unit(unpack(group.column("x")[k].as_py(), dim))
            held.append((group.column("block")[k].as_py(), start, x, quantise(x), np.frombuffer(group.column("centre")[k].as_py()), group.column("radius")[k].as_py()))
            start += len(x)
        rows = np.concatenate([group.column("rows")[k].values.to_numpy() for k in np.argsort(group.column("pack").to_numpy()).tolist()])
        n, root = np.zeros(start, np.int64), np.arange(start)
        for p, (a, at, x, qx, c, r) in enumerate(held):
            for q in range(p, len(held)):
                b, to, y, qy, d, s = held[q]
                if (a, b) != (lo, hi) or np.arccos(np.clip(c @ d, -1, 1)) - r - s > limit:
                    continue
                for i, j in tile(x, y, qx, qy, threshold, p == q):
                    n[at : at + len(x)] += np.bincount(i, minlength=len(x))
                    n[to : to + len(y)] += np.bincount(j, minlength=len(y))
                    root = merge(root, i + at, j + to)
        some, moved = np.flatnonzero(n), np.flatnonzero(root != np.arange(start))
        columns = [np.concatenate([rows[some], rows[moved]]), pa.array([*n[some].tolist(), *[None] * len(moved)], pa.int64()), pa.array([*[None] * len(some), *rows[root[moved]].tolist()], pa.int64())]
        return pa.Table.from_arrays([pa.array(columns[0], pa.int64()), *columns[1:]], names=["row", "n", "root"])

    return sent.groupBy("tile").applyInArrow(meet, "row long, n long, root long")


def op10_embedding_near_dedup(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok AS a JOIN ok AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), r(id, c) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id
), k AS (
  SELECT id, min(c) AS component_id FROM r GROUP BY id
)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, k.component_id, v.vec_id = k.component_id AS kept
FROM v JOIN k ON k.id = v.vec_id
"""
