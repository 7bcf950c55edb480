"""Substring dedup: remove words covered by long passages that occur elsewhere too, by seed and extend.

Seeds are winnowed anchors: of every ``span`` consecutive runs of ``seed`` words the one with the smallest hash is
selected, so any ``window`` = seed + span - 1 words hold a selected seed, the same one wherever those words stand. Documents meet on
seeds that occur at least twice. Around each of these, to both sides, every window that holds the seed is looked up among the
windows around all other shared seeds; those that occur elsewhere make up, in union, the maximal repeats. Pairs of documents are not extended word by word:
in a group of n copies that would be n * n extensions.

The texts are exchanged once, into chunks by a hash of doc_id and text (repeated rows with more text than a chunk holds go to several); each
step reads that same exchange. What travels beside it are compact lists: each chunk sends its distinct seeds (later: its distinct windows around shared seeds) to
hash buckets, once each with a mark if the chunk itself holds two, and gets back one bit each. A passage that a third of all documents
share is thus one entry a chunk, and no group of its occurrences ever meets in a task.

Windows are compared by 96 bits of two independent hashes of their words' 128 bits, seeds by 64 (a false seed only makes work).

Defined cases: null and empty texts have no words; texts shorter than the window are kept whole; repeated rows are documents
of their own, so their long texts remove each other; null doc_ids are allowed; an empty table gives no rows; extra columns are kept, but
those named like a result column give way to it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bound_batches, inner, materialize, read, without
from .textnum import Words, mix, whitespace_table

#: Bounds of the numbers of chunks and buckets; between them both follow the input. At the upper bounds chunks and buckets grow
#: instead: at 100 TB to 25 MB of text and, with every window near a shared seed, some 200 MB of hashes.
LEAST, MOST_CHUNKS, MOST_BUCKETS = 64, 4 << 20, 1 << 20


def select(hashes: np.ndarray, inside: np.ndarray, span: int) -> np.ndarray:
    """Indices into the runs that winnowing selects. inside: word index of each run; runs of one document are consecutive."""
    n = len(hashes)
    if n < span:
        return np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes, span)
    best = np.empty(len(view), np.int64)
    for k in range(0, len(view), 1 << 18):
        best[k : k + (1 << 18)] = view[k : k + (1 << 18)].argmin(1)
    best += np.arange(len(view))
    whole = inside[span - 1 :] - inside[: n - span + 1] == span - 1  # all runs of the view lie in one document
    return np.unique(best[whole])


class Chunk:
    """Seeds and windows of the texts of a chunk."""

    def __init__(self, texts, window: int, seed: int):
        self.words = Words(texts, whitespace_table())
        hashes, self.check = self.words.keys()
        self.window, self.seed = window, seed
        runs, at = self.words.windows(hashes, seed)
        chosen = select(runs, at, window - seed + 1)
        self.seeds, self.seed_at = runs[chosen], at[chosen]
        self.hashes = hashes

    def around(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, second hashes and first words of the windows that hold a seed for which ``shared`` is true."""
        runs, at = self.words.windows(self.hashes, self.window)
        check, _ = self.words.windows(self.check, self.window)
        near = np.zeros(len(self.words) + 1, np.int64)
        starts = self.seed_at[shared]
        begin = np.repeat(self.words.first[:-1], self.words.counts)  # not before the text: other texts' order is arbitrary
        np.add.at(near, np.maximum(starts - (self.window - self.seed), begin[starts]), 1)
        np.add.at(near, starts + 1, -1)
        holds = np.cumsum(near)[at] > 0  # a window from starts-(window-seed) to starts holds the seed
        return runs[holds], (check[holds] >> np.uint64(32)).astype(np.uint32), at[holds]


def distinct(hashes: np.ndarray, check: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs of hashes, bucket by bucket: both values, whether met twice, bucket bounds, and the place of each input."""
    bucket = mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)
    order = np.lexsort((check, hashes, bucket))
    h, c, b = hashes[order], check[order], bucket[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    place = np.empty(len(h), np.int64)
    place[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    twice = np.diff(np.append(first, len(h))) > 1
    return h[first], c[first], twice, np.searchsorted(b[first], np.arange(buckets + 1).astype(np.uint64)), place


def no_check(hashes: np.ndarray) -> np.ndarray:
    return np.zeros(len(hashes), np.uint32)


def _send(chunk: int, hashes: np.ndarray, check: np.ndarray, buckets: int) -> pa.Table:
    values, second, twice, bounds, _ = distinct(hashes, check, buckets)
    checked = bool(second.any())
    some = np.flatnonzero(np.diff(bounds))
    return pa.Table.from_arrays(
        [
            pa.array([chunk] * len(some), pa.int32()),
            pa.array(some, pa.int32()),
            pa.array([values[bounds[k] : bounds[k + 1]].tobytes() for k in some], pa.binary()),
            pa.array([second[bounds[k] : bounds[k + 1]].tobytes() if checked else b"" for k in some], pa.binary()),
            pa.array([np.packbits(twice[bounds[k] : bounds[k + 1]]).tobytes() for k in some], pa.binary()),
        ],
        names=["chunk", "bucket", "hashes", "checks", "twice"],
    )


def _shared(key, group):
    """For each chunk's list of a bucket, a bit for every hash: does it occur at least twice in the corpus?"""
    lists = [np.frombuffer(b, np.uint64) for b in group.column("hashes").to_pylist()]
    twice = [np.unpackbits(np.frombuffer(b, np.uint8))[: len(h)].astype(bool) for b, h in zip(group.column("twice").to_pylist(), lists, strict=True)]
    checks = [np.frombuffer(b, np.uint32) if b else no_check(h) for b, h in zip(group.column("checks").to_pylist(), lists, strict=True)]
    every, check, again = np.concatenate(lists), np.concatenate(checks), np.concatenate(twice)
    order = np.lexsort((check, every)) if check.any() else np.argsort(every, kind="stable")
    h, c = every[order], check[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    first = np.flatnonzero(new)
    met = (np.diff(np.append(first, len(h))) > 1) | np.logical_or.reduceat(again[order], first)
    out = np.empty(len(h), bool)
    out[order] = met[np.cumsum(new) - 1]
    bits = np.split(out, np.cumsum([len(x) for x in lists])[:-1])
    return pa.Table.from_arrays(
        [group.column("chunk").combine_chunks(), group.column("bucket").combine_chunks(), pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())], names=["chunk", "bucket", "shared"]
    )


def _bits(hashes: np.ndarray, check: np.ndarray, replies: pa.Table, buckets: int) -> np.ndarray:
    """The replies' bit for each pair of hashes."""
    values, _, _, bounds, place = distinct(hashes, check, buckets)
    met = np.zeros(len(values), bool)
    for b, bits in zip(replies.column("bucket").to_pylist(), replies.column("shared").to_pylist(), strict=True):
        n = bounds[b + 1] - bounds[b]
        met[bounds[b] : bounds[b + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8))[:n]
    return met[place]


REPLY = "chunk int, bucket int, shared binary"
LISTS = "chunk int, bucket int, hashes binary, checks binary, twice binary"


def _salted(docs: DataFrame, text: str, doc_id: str, chunk: str, chunk_bytes: int) -> tuple[DataFrame, int, int]:
    """docs with the number of each row's chunk, the number of chunks, and the bytes of all texts.

    Rows go by a hash of doc_id and text, those of equal doc_id and text so to one chunk. Where such a group has more text than a chunk,
    its rows are dealt over as many chunks as hold it: chunks count what they share, so a passage is found whichever chunks have it. Groups of that size are at most as many as
    there are chunks (MOST_CHUNKS), so their table is broadcast.
    """
    if docs.isEmpty():  # nothing would be observed
        return docs.withColumn(chunk, F.lit(0)), LEAST, 0
    total = Observation()
    size = F.octet_length(text)
    rows = docs.select(F.xxhash64(doc_id, text).alias("h"), size.alias("n")).observe(total, F.sum("n").alias("n"))
    groups = rows.groupBy("h").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    groups = materialize(groups.where((F.col("rows") > 1) & (F.col("n") > chunk_bytes)).select("h", "n"), "repeated")
    total = total.get["n"] or 0
    chunks = max(LEAST, min(-(-total // chunk_bytes), MOST_CHUNKS))
    own = F.xxhash64(doc_id, text)
    share = max(chunk_bytes, total // chunks)
    large = groups.where(F.col("n") > share)
    if large.isEmpty():
        return docs.withColumn(chunk, F.pmod(own, F.lit(chunks)).cast("int")), chunks, total
    pieces = large.select(F.col("h").alias(f"{chunk}h"), F.ceil(F.col("n") / share).alias(f"{chunk}k"))
    dealt = docs.withColumns({f"{chunk}own": own, f"{chunk}row": F.monotonically_increasing_id()})
    dealt = dealt.join(F.broadcast(pieces), F.col(f"{chunk}own") == F.col(f"{chunk}h"), "left")
    piece = F.coalesce(F.pmod(F.xxhash64(f"{chunk}row"), f"{chunk}k"), F.lit(0))
    return dealt.select(*(F.col(f"`{c}`") for c in docs.columns), F.pmod(F.pmod(f"{chunk}own", F.lit(chunks)) + piece, F.lit(chunks)).cast("int").alias(chunk)), chunks, total


def repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = 35, seed: int = 18, chunk_bytes: int = 6 << 20, bucket_bytes: int = 24 << 20, keep_text: bool = True) -> DataFrame:
    """docs with n_words, n_removed, kept (words joined by one space; only with keep_text), kept_sha256 and spans:
    the removed word ranges [first, last) of each text, which are its maximal repeats.
    """
    docs = without(docs, "n_words", "n_removed", "kept", "kept_sha256", "spans")
    spark = docs.sparkSession
    bound_batches(spark)
    chunk = f"{inner(docs)}chunk"
    salted, chunks, total = _salted(docs, text, doc_id, chunk, chunk_bytes)
    buckets = max(LEAST, min(-(-total // bucket_bytes), MOST_BUCKETS))
    parts = min(chunks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), chunks // 4))
    dealt = salted.repartition(parts, chunk)
    kept = [c for c in docs.columns if c != text]

    def seeds(key, group):
        c = Chunk(group.column(text), window, seed)
        return _send(key[0].as_py(), c.seeds, no_check(c.seeds), buckets)

    def windows(key, group, replies):
        if not group.num_rows:
            return _send(0, np.empty(0, np.uint64), np.empty(0, np.uint32), buckets)
        c = Chunk(group.column(text), window, seed)
        runs, check, _ = c.around(_bits(c.seeds, no_check(c.seeds), replies, buckets))
        return _send(key[0].as_py(), runs, check, buckets)

    def remove(key, group, first, second):
        c = Chunk(group.column(text), window, seed)
        runs, check, at = c.around(_bits(c.seeds, no_check(c.seeds), first, buckets))
        hit = at[_bits(runs, check, second, buckets)]
        edge = np.zeros(len(c.words) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + window, -1)
        gone = np.cumsum(edge)[:-1] > 0
        return finish(c.words, gone, group)

    out = T.StructType([f for f in docs.schema.fields if f.name != text])
    for f in T.StructType.fromDDL("n_words long, n_removed long, kept_sha256 string, spans array<struct<first:long,last:long>>" + (", kept string" if keep_text else "")).fields:
        out = out.add(f)

    def finish(words: Words, gone: np.ndarray, group: pa.Table) -> pa.Table:
        raw = words.raw.tobytes()
        removed = np.concatenate([[0], np.cumsum(gone)])
        digests, spans, texts = [], [], []
        for d in range(len(words.counts)):
            a, b = int(words.first[d]), int(words.first[d + 1])
            if removed[b] == removed[a]:
                body = b" ".join(raw[words.offsets[d] : words.offsets[d + 1]].split())
                spans.append([])
            else:
                own = gone[a:b]
                body = b" ".join(raw[s:e] for s, e in zip(words.start[a:b][~own].tolist(), words.end[a:b][~own].tolist(), strict=True))
                turn = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                spans.append([{"first": int(x), "last": int(y)} for x, y in turn.reshape(-1, 2)])
            digests.append(hashlib.sha256(body).hexdigest())
            if keep_text:
                texts.append(body.decode())
        columns = [group.column(c).combine_chunks() for c in kept]
        columns += [pa.array(words.counts, pa.int64()), pa.array(removed[words.first[1:]] - removed[words.first[:-1]], pa.int64()), pa.array(digests, pa.string())]
        columns.append(pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))))
        names = [*kept, "n_words", "n_removed", "kept_sha256", "spans"]
        if keep_text:
            columns.append(pa.array(texts, pa.string()))
            names.append("kept")
        return pa.Table.from_arrays(columns, names=names)

    sent = dealt.groupBy(chunk).applyInArrow(seeds, LISTS)
    first = sent.groupBy("bucket").applyInArrow(_shared, REPLY)
    first = first.repartition(parts, "chunk")
    sent = dealt.groupBy(chunk).cogroup(first.groupBy("chunk")).applyInArrow(windows, LISTS)
    second = sent.groupBy("bucket").applyInArrow(_shared, REPLY)
    both = first.withColumn("step", F.lit(1)).unionByName(second.withColumn("step", F.lit(2)))

    def last(key, group, replies):
        if not group.num_rows:
            return pa.Table.from_batches([], schema=empty)
        step = replies.column("step").to_numpy()
        return remove(key, group, replies.filter(pa.array(step == 1)), replies.filter(pa.array(step == 2)))

    empty = to_arrow_schema(out)
    return dealt.groupBy(chunk).cogroup(both.groupBy("chunk")).applyInArrow(last, out)


def op3_substring_dedup(spark, sf_dir):
    return repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False).drop("spans")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents
), p AS (
  SELECT doc_id, i, hash(w[i:i + 34]) AS h, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM d, unnest(range(1, len(w) - 33)) AS u(i)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM p) AS x WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM r
), words AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d
), kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.k) AS s, count(*) AS n
  FROM words LEFT JOIN gone USING (doc_id, k) WHERE gone.k IS NULL GROUP BY words.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
