"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark items are normalised (A-Z lower-cased, words of ``alnum_table``) and cut into windows of
``window`` words; an item of fewer words is one window. Every word of the benchmark gets a symbol, so a
window is a short string of symbols, and a document becomes one string over the same symbols, in which
words unknown to the benchmark are symbol 1. The automaton reads that string once and gives the word
positions of every occurrence; word positions map to byte or character spans of the original text.

The automaton is broadcast. Its size follows the benchmark, not the corpus, and is checked: beyond
``max_windows`` windows the benchmark is scanned in several automata, one pass over the documents each.

Defined cases: null and empty texts have no words and no hits; null or word-less items never match; items with
null ids match but are not listed; repeated documents each get their own row; a text of any length is
scanned whole; an empty table gives no rows; extra columns are kept, but those named like a result column give way to it.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, gather, materialize, read, without
from .textnum import Words, alnum_table

RESULT = "n_words long, hits array<struct<first:int,last:int,begin:long,end:long>>, items array<string>"
BREAK = "\x02"  # between documents; no window has it
UNKNOWN = 1


SPAN = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("begin", pa.int64()), ("end", pa.int64())])
_scanners: dict[str, object] = {}


def build(items: list[tuple[str | None, str | None]], window: int) -> tuple[list[bytes], dict[str, list[str]]]:
    """The words that have symbols, in the symbols' order, and window string -> item ids."""
    words = Words(pa.array([t for _, t in items], pa.large_string()), alnum_table())
    known, number = words.distinct()
    text = symbols(len(known))[number].tobytes().decode("utf-32-le")
    windows: dict[str, list[str]] = {}
    for k, (item, _) in enumerate(items):
        a, b = words.first[k], words.first[k + 1]
        for i in range(a, max(b - window, a) + 1) if b > a else ():
            ids = windows.setdefault(text[i : min(i + window, b)], [])
            if item is not None and item not in ids:
                ids.append(item)
    return known.to_pylist(), windows


def symbols(n: int) -> np.ndarray:
    """Characters for n words."""
    found = (np.arange(n) + 3).astype("<u4")
    found[found >= 0xD800] += 0x800  # surrogates are no characters
    return found


def runs_of(hit: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true words inside each document: first words, words after the last, and where each document's runs begin."""
    edge = np.zeros(len(hit) + 1, bool)  # true where a run ends or begins anew
    edge[first] = True
    own = np.concatenate([[False], hit, [False]])
    begin = np.flatnonzero(own[1:-1] & (~own[:-2] | edge[:-1]))
    end = np.flatnonzero(own[1:-1] & (~own[2:] | edge[1:])) + 1
    return begin, end, np.searchsorted(begin, first)


def scanner(known: list[bytes], windows: dict[str, list[str]]):
    """A function from a text column (and the spans found before, if any) to n_words, hits and items of each text, as Arrow arrays."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for k, w in enumerate(windows):
        automaton.add_word(w, k)
    if windows:
        automaton.make_automaton()
    lengths, ids = np.array([len(w) for w in windows], np.int64), list(windows.values())
    symbol = dict(zip(known, symbols(len(known)).tolist(), strict=True))

    def occurrences(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, first word and window number of every occurrence."""
        own, number = words.distinct()  # symbols stand for words by their bytes, so a hit is exact
        code = np.array([symbol.get(w, UNKNOWN) for w in own.to_pylist()], "<u4")[number]
        line = np.full(len(code) + len(words.counts), ord(BREAK), "<u4")
        line[np.arange(len(code)) + words.doc()] = code
        breaks = words.first[1:] + np.arange(1, len(words.counts) + 1)
        found = np.fromiter((x for pair in automaton.iter(line.tobytes().decode("utf-32-le")) for x in pair), np.int64).reshape(-1, 2)
        doc = np.searchsorted(breaks, found[:, 0], side="right")
        return doc, found[:, 0] - doc - lengths[found[:, 1]] + 1, found[:, 1]

    def scan(texts, before: pa.Array | None = None, named: pa.Array | None = None) -> list[pa.Array]:
        words = Words(texts, alnum_table())
        n = len(words.counts)
        edge = np.zeros(len(words) + 1, np.int64)
        items: list[set] = [set(x or ()) for x in named.to_pylist()] if named is not None else [set() for _ in range(n)]
        if windows and len(words):
            doc, first, window = occurrences(words)
            np.add.at(edge, first, 1)
            np.add.at(edge, first + lengths[window], -1)
            for key in np.unique(doc * len(ids) + window).tolist():  # a window counts once a document, however often it occurs
                items[key // len(ids)].update(ids[key % len(ids)])
        if before is not None:
            spans = before.flatten()
            base = np.repeat(words.first[:-1], pc.list_value_length(before).to_numpy())
            np.add.at(edge, base + spans.field("first").to_numpy(), 1)
            np.add.at(edge, base + spans.field("last").to_numpy() + 1, -1)
        begin, end, at = runs_of(np.cumsum(edge[:-1]) > 0, words.first)
        doc = np.repeat(np.arange(n), np.diff(at))
        fields = [begin - words.first[doc], end - 1 - words.first[doc], words.start[begin] - words.offsets[doc], words.end[end - 1] - words.offsets[doc]]
        hits = pa.StructArray.from_arrays([pa.array(x, t.type) for x, t in zip(fields, SPAN, strict=True)], fields=list(SPAN))
        return [pa.array(words.counts, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), hits), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]

    return scan


def scanner_of(key: str, sent):
    """This worker's scanner of a broadcast block of the benchmark: the automaton is built once a worker, not once a task."""
    if key not in _scanners:
        _scanners.clear()
        _scanners[key] = scanner(*sent.value)
    return _scanners[key]


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, max_windows: int = 2_000_000, keep_text: bool = True) -> DataFrame:
    """docs with the columns n_words, hits and items. hits: the maximal runs of words inside occurrences of benchmark windows, as word positions
    (first and last) and byte positions in the original UTF-8 text (begin, end); items: the ids of the items with occurring windows, sorted.

    What a document brings is bounded by its words and the benchmark's items, however many items share a window and however often it occurs.
    """
    n_windows = items.select(F.sum(F.size(F.split(F.coalesce(F.col(item_text), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))).alias("n")).first().n or 0
    n_blocks = -(-n_windows // max_windows) or 1
    numbered = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("t"))
    numbered = numbered.withColumn("block", F.pmod(F.xxhash64("item", "t"), F.lit(n_blocks)))
    docs = without(docs, "n_words", "hits", "items")
    spark, found = docs.sparkSession, docs
    bound_batches(spark)
    for block in range(n_blocks):
        # one block of the benchmark, at most about max_windows windows
        rows = [(r.item, r.t) for r in numbered.where(F.col("block") == block).toLocalIterator()]
        sent = spark.sparkContext.broadcast(build(rows, window))
        kept = [c for c in docs.columns if c != text or keep_text or block < n_blocks - 1]
        found = _scan(found, sent, text, kept, first=block == 0)
        if n_blocks > 1:
            found = materialize(found, "hits")  # one automaton at a time in a worker
    return found


def _scan(docs: DataFrame, sent, text: str, kept: list[str], first: bool) -> DataFrame:
    key = uuid.uuid4().hex

    def run(batches):
        scan = scanner_of(key, sent)
        for batch in gather(batches, text):
            found = scan(batch.column(text)) if first else scan(batch.column(text), batch.column("hits"), batch.column("items"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *found], names=[*kept, "n_words", "hits", "items"])

    schema = docs.select(*(F.col(f"`{c}`") for c in kept)).schema
    for f in T.StructType.fromDDL(RESULT).fields:
        schema = schema.add(f)
    return docs.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """The per-document report: n_words, n_hit (words inside any occurrence), the items, and whether any hit."""
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"] + 1)
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op1_decontamination(spark, sf_dir):
    return digest(decontaminate(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"), keep_text=False))


OP1_SQL = r"""
WITH bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:least(i + 9, len(w))], ' ') AS g
  FROM bw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0
), dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), occ AS (
  SELECT doc_id, item, i, n FROM (
    SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
    FROM dw, (SELECT DISTINCT n FROM win) AS sizes, unnest(range(1, len(w) - n + 2)) AS u(i)
  ) AS d JOIN win USING (g, n)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM occ, unnest(range(i, i + n)) AS u(p) GROUP BY doc_id
), ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM occ) AS x GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
