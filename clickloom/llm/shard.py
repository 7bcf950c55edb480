"""Sharding by histogram sort.

Documents are ordered by the key (xxhash64 of the text, doc_id), so equal texts lie together and sources mix. To
cut that order into ranges of equal bytes, every round counts the exact bytes and rows below a set of probe keys,
one small histogram per partition summed by Spark, and narrows each splitter's interval to the two probes around
its target. A splitter is settled once the bytes below it are within tolerance of its target or its interval holds
a single hash; then equal texts stay together unless their group is too large for that, and the cut goes on by doc_id inside the group.
Only probes and their counts (a number fixed by the shard count and the target part size) come to the driver.
The documents then move once, straight to their ranges.

Where a cut falls among rows of equal text and doc_id, which the key does not tell apart, the documents are first written once with a row number of their own, and
the search goes on by that inside the group. So a group of any size is cut anywhere.

Defined cases: a null text has no bytes and counts as size 8; null doc_ids order first; a text of any length is one row's size; an empty table gives no rows; columns beside doc_id and text are kept, but
those named like a result column give way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, inner, materialize, read, without

OVERHEAD = 8
LOW, HIGH = -(1 << 63), (1 << 63) - 1
FEW = 64  # rows of an interval whose own keys become the probes
MOST_PARTS = 1000  # ranges of a shard


def _counts(keys: DataFrame, column: str, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows whose key is below each of the sorted probes."""

    def run(batches):
        size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for batch in batches:
            at = np.searchsorted(probes, batch.column(0).to_numpy(), side="right")
            np.add.at(size, at, batch.column(1).to_numpy())
            np.add.at(rows, at, 1)
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(size[some]), pa.array(rows[some])], names=["at", "size", "n"])

    found = keys.select(column, "size").mapInArrow(run, "at long, size long, n long").groupBy("at").agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
    size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for r in found.collect():  # at most a row per probe
        size[r["at"]], rows[r["at"]] = r["size"], r["n"]
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


class _Repeated(Exception):
    """A cut falls among rows that the key does not tell apart."""


def _between(keys: DataFrame, column: str, spans: list[tuple[int, int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """The rows (hash, doc_id, row, size) whose key lies in one of the disjoint spans [lo, hi), by lo."""
    lo, hi = np.array([x[0] for x in spans], np.int64), np.array([x[1] for x in spans], np.int64)
    where = keys.columns.index(column)

    def run(batches):
        for batch in batches:
            key = batch.column(where).to_numpy()
            at = np.searchsorted(lo, key, side="right") - 1
            yield batch.filter(pa.array((at >= 0) & (key < hi[at])))

    found: dict[int, list[tuple[int, int, int, int]]] = {x[0]: [] for x in spans}
    for r in keys.mapInArrow(run, keys.schema).collect():  # at most FEW rows a span
        found[int(lo[np.searchsorted(lo, r[column], side="right") - 1])].append((r["hash"], r["doc_id"], r["row"] if "row" in keys.columns else LOW, r["size"]))
    return found


def _refine(keys: DataFrame, column: str, targets: list[float], tolerance: float, each: int, low: int = LOW, high: int = HIGH) -> list[tuple[int, ...] | dict]:
    """For each target the cut with the bytes below nearest to it, or its interval if that is one key of many rows."""
    edges = [{"lo": low, "lo_size": 0, "lo_rows": 0, "hi": None} for _ in targets]
    out: list = [None] * len(targets)
    wanted = {low + ((high - low) * k) // (each * (len(targets) + 1)) for k in range(1, each * (len(targets) + 1))} | {high}
    while wanted:
        probes = np.array(sorted(wanted), dtype=np.int64)
        size, rows = _counts(keys, column, probes)
        few: dict[int, int] = {}
        for i, (e, target) in enumerate(zip(edges, targets, strict=True)):
            if out[i] is not None:
                continue
            k = int(np.searchsorted(size, target, side="right"))  # size[k - 1] <= target < size[k]
            if k and int(probes[k - 1]) > e["lo"]:
                e |= {"lo": int(probes[k - 1]), "lo_size": int(size[k - 1]), "lo_rows": int(rows[k - 1])}
            if k < len(probes) and (e["hi"] is None or int(probes[k]) <= e["hi"]):
                e |= {"hi": int(probes[k]), "hi_size": int(size[k]), "hi_rows": int(rows[k])}
            elif e["hi"] is None:  # only rows with the largest key are above
                e |= {"hi": high, "hi_size": e["lo_size"], "hi_rows": e["lo_rows"]}
            below, above = target - e["lo_size"], e["hi_size"] - target
            if min(below, above) <= tolerance:
                side = "lo" if below <= above else "hi"
                out[i] = (e[side], LOW, LOW, e[side + "_size"], e[side + "_rows"])
            elif e["hi_rows"] - e["lo_rows"] <= FEW:
                few[e["lo"]] = e["hi"]
            elif e["hi"] - e["lo"] <= 1:
                out[i] = e
        if few:  # the rows of these intervals are the next probes
            held = _between(keys, column, sorted(few.items()))
            for i, (e, target) in enumerate(zip(edges, targets, strict=True)):
                if out[i] is None and few.get(e["lo"]) == e["hi"]:
                    out[i] = _nearest(sorted(held[e["lo"]]), e, target, tolerance, column)
        wanted = set()
        for i, e in enumerate(edges):
            if out[i] is None:
                wanted |= {e["lo"] + (e["hi"] - e["lo"]) * k // (each + 1) for k in range(1, each + 1)}
    return out


def _nearest(rows: list[tuple[int, int, int, int]], e: dict, target: float, tolerance: float, column: str) -> tuple[int, ...]:
    """The cut before or after one of the rows; by hash, one between different hashes if that is within tolerance.

    A cut is (value of the column, doc_id, row, bytes below, rows below); LOW where a column does not matter.
    """
    size, n, cuts, equal = e["lo_size"], e["lo_rows"], [], 0
    for k, (h, d, r, s) in enumerate(rows):
        before = rows[k - 1] if k else (None,) * 3
        if before[:3] != (h, d, r):
            if column == "hash":
                cuts.append((h, LOW if before[0] != h else d, LOW if before[:2] != (h, d) else r, size, n))
            else:
                cuts.append((d if column == "doc_id" else r, LOW, LOW if column == "row" or before[1] != d else r, size, n))
        else:
            equal = max(equal, s)
        size, n = size + s, n + 1
    cuts.append((e["hi"], LOW, LOW, size, n))
    best = min((c for c in cuts if c[1:3] == (LOW, LOW)), key=lambda c: abs(c[3] - target))
    if abs(best[3] - target) <= tolerance:
        return best
    best = min(cuts, key=lambda c: abs(c[3] - target))
    if equal and abs(best[3] - target) > max(tolerance, equal / 2):
        raise _Repeated
    return best


def splitters(keys: DataFrame, n_parts: int, total: int, tolerance: float = 0.005, each: int = 16) -> list[tuple[int, int, int, int, int]]:
    """n_parts - 1 cuts (hash, doc_id, row, bytes below, rows below), in order; tolerance is a share of a part.

    A row lies below a cut if its hash is smaller, or equal with a smaller doc_id, or both equal with a smaller row. keys: hash, doc_id, size and, if
    rows are numbered, row; without it _Repeated says that a cut needs it.
    """
    share = total / n_parts
    targets = [share * k for k in range(1, n_parts)]
    return sorted(_cuts(keys, ["hash", "doc_id", "row"], targets, tolerance * share, each, {"lo_size": 0, "lo_rows": 0}, LOW, HIGH))


def _cuts(keys: DataFrame, columns: list[str], targets: list[float], tolerance: float, each: int, base: dict, low: int, high: int) -> list[tuple[int, ...]]:
    """Cuts as values of the columns, bytes and rows below; targets and results count from base on."""
    column, *rest = columns
    found = _refine(keys, column, [t - base["lo_size"] for t in targets], tolerance, each, low, high)
    out: list = []
    inside: dict[int, list[int]] = {}
    for k, c in enumerate(found):
        if isinstance(c, dict):
            inside.setdefault(c["lo"], []).append(k)
        else:  # the values found, without those of columns that this level has fixed
            out.append((*((c[0], *c[1:3])[: len(columns)] if column == "hash" else (c[0], c[2])[: len(columns)]), base["lo_size"] + c[3], base["lo_rows"] + c[4]))
    for value, ks in inside.items():  # a group of equal values larger than the tolerance lies across these targets
        if not rest or rest[0] not in keys.columns:
            raise _Repeated
        e, group = found[ks[0]], keys.where(F.col(column) == value)
        ends = group.agg(F.min(rest[0]).alias("a"), F.max(rest[0]).alias("b")).first()
        down = {"lo_size": base["lo_size"] + e["lo_size"], "lo_rows": base["lo_rows"] + e["lo_rows"]}
        out += [(value, *c) for c in _cuts(group, rest, [targets[k] for k in ks], tolerance, each, down, max(ends.a - 1, LOW), min(ends.b + 1, HIGH))]
    return out


def shard(docs: DataFrame, n_shards: int = 24, text: str = "text", doc_id: str = "doc_id", part_bytes: int = 64 << 20, least_parts: int = 96) -> DataFrame:
    """docs with the columns shard and slot: near-equal bytes in each shard, slots gapless from 0 in key order.

    A shard is made of several consecutive ranges of about part_bytes, so that no task holds a shard; a range's
    first slot is known from the row counts at its cut, and its rows are numbered inside one task.
    """
    docs = without(docs, "shard", "slot")
    spark, p = docs.sparkSession, inner(docs)
    bound_batches(spark)
    keyed = docs.withColumns({f"{p}hash": F.xxhash64(F.coalesce(F.col(text), F.lit(""))), f"{p}id": F.coalesce(F.col(doc_id).cast("long"), F.lit(LOW))})
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + OVERHEAD
    keys = materialize(keyed.select(F.col(f"{p}hash").alias("hash"), F.col(f"{p}id").alias("doc_id"), size.alias("size")), "shard-keys")
    total = keys.agg(F.sum("size").alias("s")).first().s or 0
    each = max(-(-least_parts // n_shards), -(-total // (n_shards * part_bytes)))
    each = min(each, MOST_PARTS)
    try:
        cuts, number = splitters(keys, n_shards * each, total), F.lit(0).cast("long")
    except _Repeated:
        keyed = materialize(keyed.withColumn(f"{p}row", F.monotonically_increasing_id()), "numbered-documents")
        keys = materialize(keyed.select(F.col(f"{p}hash").alias("hash"), F.col(f"{p}id").alias("doc_id"), F.col(f"{p}row").alias("row"), size.alias("size")), "shard-keys")
        cuts, number = splitters(keys, n_shards * each, total), F.col(f"{p}row")
    first = [0, *(c[4] for c in cuts)]
    place = _placer([c[:3] for c in cuts])

    @F.arrow_udf("int")
    def part(h: pa.Array, d: pa.Array, r: pa.Array) -> pa.Array:  # reads keys only: texts stay in the JVM
        return pa.array(place(*(x.to_numpy(zero_copy_only=False) for x in (h, d, r))))

    parts = n_shards * each
    moved = keyed.withColumn(f"{p}part", part(F.col(f"{p}hash"), F.col(f"{p}id"), number)).repartitionById(parts, f"{p}part")  # a range, a task
    slot = F.row_number().over(W.partitionBy(f"{p}part").orderBy(f"{p}hash", f"{p}id")) - 1
    base = F.broadcast(spark.createDataFrame([(k, k // each, first[k] - first[k // each * each]) for k in range(parts)], f"{p}k int, shard int, {p}base long"))  # a row per range
    moved = moved.withColumn(f"{p}slot", slot).join(base, F.col(f"{p}part") == F.col(f"{p}k"), "left")
    return moved.select(*(F.col(f"`{c}`") for c in docs.columns), "shard", (F.col(f"{p}base") + F.col(f"{p}slot")).alias("slot"))


def _placer(cuts: list[tuple[int, int, int]]):
    hashes, ids, rows = (np.array([c[k] for c in cuts], np.int64) for k in range(3))

    def place(h: np.ndarray, d: np.ndarray, r: np.ndarray) -> np.ndarray:
        part = np.searchsorted(hashes, h, side="left")  # cuts with a smaller hash
        at = np.flatnonzero(np.searchsorted(hashes, h, side="right") > part)  # rows with a cut inside or right before their hash
        for value in np.unique(h[at]).tolist():
            own = at[h[at] == value]
            for k in range(np.searchsorted(hashes, value, side="left"), np.searchsorted(hashes, value, side="right")):
                part[own] += (d[own] > ids[k]) | ((d[own] == ids[k]) & (r[own] >= rows[k]))
        return part.astype(np.int32)

    return place


def op2_sharding(spark, sf_dir):
    """Law: bytes. Size and checksum are taken from the documents as they arrive in their shards."""
    moved = shard(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return moved.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
