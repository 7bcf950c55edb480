"""Mixing sources to target weights by Pfair scheduling.

The documents of a source, in hash order, are cut into blocks of text. Time is counted in blocks: the mix takes one in
each slot. Block i (from 1) of a source of weight w is released at floor((i - 1) / w) and due at ceil(i / w), and every slot
takes the released block that is due first (ties: the heavier source, then the name). As the weights sum to 1, every block meets its
window, so after any number of slots t each source has had w t blocks to within less than one. Weights are exact: whole numbers in the
proportion of the given or computed ones, never rounded to slots.

A source that has run out drops out: the others go on by their renormalised weights, from that slot on, down to their last
block. Windows and deviation then count from there.

The schedule is made on the driver, slot by slot, so the number of slots is bounded: a block has ``block_bytes`` of text, or as many as cut the
corpus into ``most_slots`` blocks if that is more (400 MB each at 100 TB). Every block is scheduled; documents find theirs by a join.

By default weights are the sources' shares of bytes raised to ``power`` (tempered sampling), and every document is chosen (``fill``). Without
``fill`` the mix ends with the last block of the first source to run out, so that what is chosen has the target weights, to within a block of each source; what is left
of the others is over-weight and not chosen. Only sources of at least ``LEAST`` of the mean size can end it: smaller ones drop out, so that a tiny source does not
cost the corpus. With given weights the mix ends where the first source would run out by these weights, and not before that source's last block; what is left of
the others is over-weight and not chosen, nor are sources without a weight. This loss is what the given weights ask for, not a cap.

Running byte counts within a source are formed in two steps (hash ranges of bounded size, then inside each), so a
source may hold any share of all rows.

Defined cases: a null source is a source of its own; null and empty texts have size 1 so that they have a place; repeated rows each have
their own; an empty table gives no rows; extra columns are kept,
but those named like a result column give way to it.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import inner, materialize, read, without

MOST_SOURCES = 4096
LEAST = 0.1
MOST_RANGES = 1 << 20  # beyond it (1 TB of a source) ranges grow


def schedule(blocks: dict, weights: dict) -> list[tuple]:
    """(source, block, release, deadline) for every slot, by earliest deadline first; blocks: how many each source has."""
    exact = {s: Fraction(weights[s]) for s in blocks}
    common = math.lcm(*(w.denominator for w in exact.values())) if exact else 1
    whole = {s: int(w * common) for s, w in exact.items()}
    names = sorted((s for s in blocks if blocks[s] > 0), key=lambda s: (-whole[s], repr(s)))
    had = dict.fromkeys(names, 0)
    out: list[tuple] = []
    while names:  # until the next source runs out
        start, total = len(out), sum(whole[s] for s in names)
        waiting = [(0, r, 1) for r in range(len(names))]  # release, source, block since start
        ready: list[tuple[int, int, int]] = []
        while True:
            while waiting and waiting[0][0] <= len(out) - start:
                _, r, i = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-i * total // whole[names[r]]), r, i))
            due, r, i = heapq.heappop(ready)
            s = names[r]
            had[s] += 1
            out.append((s, had[s], start + (i - 1) * total // whole[s], start + due))
            if had[s] == blocks[s]:
                break
            heapq.heappush(waiting, (i * total // whole[s], r, i + 1))
        names.remove(s)
    return out


def mix(docs: DataFrame, weights: dict | None = None, power: float = 0.7, fill: bool = True, source: str = "source", text: str = "text", doc_id: str = "doc_id", block_bytes: int = 16_384, most_slots: int = 1 << 18, range_bytes: int = 1 << 20) -> DataFrame:
    """docs with block (from 1, in its source), release, deadline, slot (its place in the mix) and chosen."""
    docs = without(docs, "block", "release", "deadline", "slot", "chosen")
    spark, p = docs.sparkSession, inner(docs)
    own = F.col(f"`{source}`")
    size = F.greatest(F.coalesce(F.octet_length(text), F.lit(0)), F.lit(1)).cast("long")
    keyed = docs.withColumns({f"{p}size": size, f"{p}hash": F.xxhash64(doc_id, text), f"{p}tie": F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))})
    totals = keyed.groupBy(own.alias(f"{p}s")).agg(F.sum(f"{p}size").alias(f"{p}n")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: group them first")
    held = {r[0]: r[1] for r in totals}
    given = weights is not None
    weights = {s: weights[s] for s in held if weights.get(s, 0) > 0} if given else {s: b**power for s, b in held.items()}
    block_bytes = max(block_bytes, -(-sum(held.values()) // most_slots))
    blocks = {s: -(-held[s] // block_bytes) for s in weights}
    line = schedule(blocks, weights)
    end = len(line)
    if given and line:
        first = min(blocks, key=lambda s: (blocks[s] / Fraction(weights[s]), repr(s)))
        last = next(t for t, x in enumerate(line) if x[:2] == (first, blocks[first]))
        end = max(math.ceil(blocks[first] * sum(map(Fraction, weights.values())) / Fraction(weights[first])), last + 1)
    elif not fill and line:
        large = [s for s in blocks if held[s] * len(held) >= LEAST * sum(held.values())]
        end = min(t for t, x in enumerate(line) if x[0] in large and x[1] == blocks[x[0]]) + 1
    number = {s: k for k, s in enumerate(blocks)}
    kind = docs.schema[source].dataType.simpleString()
    numbers = F.broadcast(spark.createDataFrame([(s, k) for s, k in number.items()], f"{p}name {kind}, {p}k int"))  # a row per source
    columns = [[number[x[0]] for x in line], *([x[k] for x in line] for k in (1, 2, 3)), list(range(len(line)))]
    names = [f"{p}{c}" for c in ("at", "block", "release", "deadline", "slot")]
    table = F.broadcast(spark.createDataFrame(pa.Table.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)))  # at most most_slots + MOST_SOURCES rows

    ranges = max(1, min(-(-max(held.values(), default=1) // range_bytes), MOST_RANGES))
    keyed = keyed.withColumn(f"{p}range", F.floor(F.shiftrightunsigned(f"{p}hash", 33).cast("double") / (1 << 31) * ranges).cast("int"))
    sizes = materialize(keyed.groupBy(own.alias(f"{p}source"), F.col(f"{p}range").alias(f"{p}r")).agg(F.sum(f"{p}size").alias(f"{p}bytes")), "mix-ranges")
    before = F.sum(f"{p}bytes").over(W.partitionBy(f"{p}source").orderBy(f"{p}r")) - F.col(f"{p}bytes")
    sizes = sizes.select(f"{p}source", f"{p}r", before.alias(f"{p}before"))
    inside = F.sum(f"{p}size").over(W.partitionBy(own, f"{p}range").orderBy(f"{p}hash", doc_id, f"{p}tie").rowsBetween(W.unboundedPreceding, 0)) - F.col(f"{p}size")
    placed = keyed.withColumn(f"{p}inside", inside).join(sizes, own.eqNullSafe(F.col(f"{p}source")) & (F.col(f"{p}range") == F.col(f"{p}r")))
    placed = placed.withColumn(f"{p}b", F.expr(f"({p}before + {p}inside) div {block_bytes}") + 1)
    placed = placed.join(numbers, own.eqNullSafe(F.col(f"{p}name")), "left")
    placed = placed.join(table, (F.col(f"{p}k") == F.col(f"{p}at")) & (F.col(f"{p}b") == F.col(f"{p}block")), "left")
    return placed.select(
        *(F.col(f"`{c}`") for c in docs.columns),
        F.col(f"{p}b").alias("block"),
        *(F.col(f"{p}{c}").alias(c) for c in ("release", "deadline", "slot")),
        F.coalesce(F.col(f"{p}slot") < end, F.lit(False)).alias("chosen"),
    )


def op5_mixing(spark, sf_dir):
    """Every document with its block, the block's window and its place; slots are gapless over the blocks."""
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "source", "block", "release", "deadline", "slot", "chosen")
