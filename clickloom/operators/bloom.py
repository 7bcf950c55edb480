"""Semi joins behind a Bloom filter.

A filter of the small side's keys is built by Spark as partial bit masks that are merged by OR, and reaches the large side's scan as the value of a scalar
subquery: rows whose key is surely not among the keys go before the exchange of the join. The join itself stays, so false positives go too.
The filter's size is checked: beyond ``most_bits`` (2 MB) there is none, and the join is the plain one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = 4


@dataclass(frozen=True)
class Bloom:
    """A filter: one row with one array of 64-bit words, and its size."""

    words: DataFrame
    bits: int

    def merge(self, other: Bloom) -> Bloom:
        """The filter of both key sets; both must have the same size."""
        if self.bits != other.bits:
            raise ValueError(f"filters of {self.bits} and {other.bits} bits do not merge")
        each = [f.words.select(F.posexplode("words").alias("word", "mask")) for f in (self, other)]
        return Bloom(_packed(each[0].unionByName(each[1])), self.bits)

    def maybe(self, key: Column) -> Column:
        """False where the key surely is not among the filter's; null keys never are."""
        words, every = self.words.scalar(), key.isNotNull()
        for k in range(HASHES):
            word, bit = _place(key, k, self.bits)
            every = every & (F.bit_get(F.get(words, word), bit) == 1)
        return every


def _place(key: Column, k: int, bits: int) -> tuple[Column, Column]:
    at = F.xxhash64(F.lit(k), key).bitwiseAND(F.lit(bits - 1))
    return F.shiftright(at, 6).cast("int"), at.bitwiseAND(F.lit(63)).cast("int")


def _packed(masks: DataFrame) -> DataFrame:
    """One row with the masks in order of their words, which are all there."""
    merged = masks.groupBy("word").agg(F.bit_or("mask").alias("mask"))
    return merged.agg(F.array_sort(F.collect_list(F.struct("word", "mask"))).alias("m")).select(F.transform("m", lambda m: m["mask"]).alias("words"))


def bloom_filter(keys: DataFrame, column: str, n: int | None = None, bits_per_key: int = 10, most_bits: int = 1 << 24) -> Bloom | None:
    """A filter of a column's values, for n of them (counted if not given); None if it would need more than most_bits. Ten bits a key let about 1 in 80 others pass."""
    if n is None:
        n = keys.count()
    bits = max(64, 1 << (max(n * bits_per_key, 1) - 1).bit_length())
    if bits > most_bits:
        return None
    key = F.col(column)
    places = F.array(*(F.struct(word.alias("word"), bit.alias("bit")) for word, bit in (_place(key, k, bits) for k in range(HASHES))))
    own = keys.where(key.isNotNull()).select(F.explode(places).alias("p")).select("p.word", F.expr("shiftleft(1L, p.bit)").alias("mask"))
    empty = keys.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("mask"))
    return Bloom(_packed(own.unionByName(empty)), bits)


def bloom_semi_join(left: DataFrame, right: DataFrame, on: str, **how) -> DataFrame:
    """Rows of left whose key is among right's; most others go below the exchange."""
    keys = right.select(on)
    found = bloom_filter(keys, on, **how)
    return (left if found is None else left.where(found.maybe(F.col(on)))).join(keys, on, "left_semi")
