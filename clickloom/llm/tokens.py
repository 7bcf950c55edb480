"""Token ids in a byte-aligned variable-length code with separate control bytes.

Ids are ranked by frequency over the whole corpus, so the frequent ones have small ranks. A rank takes 1 to 4 bytes; the
lengths of four ranks share one control byte, and control and data bytes are separate streams. A decoder looks
the control bytes up in a table of 256 rows (data length, and for each of the four values its place and
length), so decoding is a few numpy operations on whole blocks.

File format: a Parquet dataset. A row is a block of consecutive documents in ascending doc_id order: part and block number its place,
doc_ids and lengths list its documents and their numbers of ids, n_ids is the length's sum, control and data are the
two streams. A second dataset, ranks, holds id and rank. Spark's writers commit whole tasks, so a lost executor
leaves no half-written block.

Words that the tokenizer's rules separate are encoded once each by a worker; see Encoder.

Defined cases: a null or empty text has only the end id; null doc_ids order first; repeated doc_ids are ordered by checksum;
a text of any length is one document of one or more blocks' size; columns other than doc_id and text are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, gather, materialize, read

END_ID = 2
MOST_WORDS = 1_000_000  # distinct words a worker remembers before it starts anew


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of each byte, and its lower-case form; bytes of class 4 are left to the tokenizer's own rules."""
    kind = np.full(256, 4, np.uint8)
    kind[0x21:0x7F] = OTHER
    kind[0x30:0x3A] = DIGIT
    kind[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, *range(0x80, 0xC0)]] = LETTER
    kind[[0x20, *range(0x09, 0x0E)]] = SPACE
    low = np.arange(256, dtype=np.uint8)
    low[0x41:0x5B] += 32
    return kind, low


SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
_KIND, _LOW = _byte_classes()
_encoders: dict[str, Encoder] = {}


# The rules that Encoder.cut() follows.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class Encoder:
    """Encodes string columns.

    Texts of ASCII and the letters U+00C0 to U+00FF are cut into the tokenizer's words on their bytes: lower-cased runs of
    letters, single digits, runs of other characters, and the contractions 's 't 're 've 'm 'll 'd where a run begins with
    them. Each distinct word is encoded once and remembered by its bytes. All other texts, those that hold
    a special token's string, and all texts where a tokenizer has other rules, are encoded whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.word = Tokenizer.from_file(path)  # for words already normal and cut
        self.word.normalizer = None
        self.word.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        rules = json.loads(self.whole.to_str())
        self.cuttable = rules["normalizer"] == NORMALIZER and rules["pre_tokenizer"] == PRE_TOKENIZER
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}  # words met, by their bytes; where their ids are, and how many
        self.at, self.length, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def learn(self, words: list[bytes]) -> None:
        ids = [e.ids for e in self.word.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        length = np.array([len(x) for x in ids], np.int64)
        for w in words:
            self.known[w] = len(self.known)
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(length.sum()))])

    @staticmethod
    def of(path: str) -> Encoder:
        """This worker's encoder, with the words of its earlier tasks."""
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased bytes, starts and ends of words, the words of each text (first), and which texts have other characters."""
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        n = len(raw)
        kind, low = _KIND[raw], _LOW[raw]
        lead = np.flatnonzero(raw == 0xC3)
        tail = lead + 1
        up = tail[(raw[tail] < 0x9F) & (raw[tail] != 0x97)]
        low[up] += 0x20
        odd = kind == 4
        follows = np.zeros(n + 1, bool)
        follows[tail] = True
        odd |= ((raw & 0xC0) == 0x80) & ~follows[:n]
        odd[tail] |= (raw[tail] == 0x97) | (raw[tail] == 0xB7)
        total = np.concatenate([[0], np.cumsum(odd)])
        strange = total[offsets[1:]] > total[offsets[:-1]]
        begin = np.zeros(n + 4, bool)
        begin[offsets] = True
        cut = begin.copy()
        cut[1:n] |= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        padded = np.concatenate([low, np.zeros(4, np.uint8)])
        at = np.flatnonzero((low == 0x27) & cut[:n])
        at = at[~begin[at + 1]]
        one = at[np.isin(padded[at + 1], np.frombuffer(b"stmd", np.uint8))]
        rest = at[~begin[at + 2]]
        pair = padded[rest + 1].astype(np.int32) << 8 | padded[rest + 2]
        two = rest[np.isin(pair, [0x7265, 0x7665, 0x6C6C])]
        cut[one + 1] = False
        cut[two + 1] = False
        cut[one + 2] = True
        cut[two + 3] = True
        edges = np.flatnonzero(cut[:n])
        ends = np.append(edges[1:], n)
        word = kind[edges] != SPACE
        starts, ends = edges[word], ends[word]
        return low, starts, ends, np.searchsorted(starts, offsets), strange

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text's end id included, and the number of ids of each text."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts, "")
        low, starts, ends, first, whole = self.cut(texts)
        for s in self.special:
            whole = whole | pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if not self.cuttable:
            whole[:] = True
        skip = np.repeat(whole, np.diff(first))
        first = np.concatenate([[0], np.cumsum(np.where(whole, 0, np.diff(first)))])
        starts, ends = starts[~skip], ends[~skip]
        edge = np.zeros(len(low) + 1, np.int8)  # the bytes of the words, one after the other
        np.add.at(edge, starts, 1)
        np.add.at(edge, ends, -1)
        body, offsets = low[np.cumsum(edge[:-1]) > 0], np.concatenate([[0], np.cumsum(ends - starts)])
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
        distinct, slot = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.known) > MOST_WORDS:
            self.forget()
        fresh = [w for w in distinct if w not in self.known]
        if fresh:
            self.learn(fresh)
        place = np.array([self.known[w] for w in distinct], np.int64)
        flat = self.flat
        base, length = self.at[place][slot], self.length[place][slot]
        total = np.concatenate([[0], np.cumsum(length)])
        n = total[first[1:]] - total[first[:-1]]
        ids = flat[np.repeat(base - total[:-1], length) + np.arange(total[-1])]
        own = {int(k): np.array(self.whole.encode(texts[int(k)].as_py(), add_special_tokens=False).ids, np.uint32) for k in np.flatnonzero(whole)}
        if own:
            parts = np.split(ids, np.cumsum(n)[:-1])
            for k, v in own.items():
                parts[k] = v
            n = np.array([len(p) for p in parts], np.int64)
            ids = np.concatenate(parts)
        out = np.empty(len(ids) + len(n), np.uint32)
        last = np.cumsum(n + 1) - 1
        keep = np.ones(len(out), bool)
        keep[last] = False
        out[keep], out[last] = ids, END_ID
        return out, n + 1


# One row for each control byte: the lengths of its four values, their places, and the length of the group.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
_PLACES = np.cumsum(_LENGTHS, 1) - _LENGTHS
_TOTAL = _LENGTHS.sum(1)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values; the last group is filled up with zeros."""
    values = np.concatenate([values.astype(np.uint32), np.zeros(-len(values) % 4, np.uint32)])
    length = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    code = (length - 1).reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    every = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), every[np.arange(4) < length[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The first n values of the two streams."""
    c = np.frombuffer(control, np.uint8)
    group = _TOTAL[c]
    base = np.cumsum(group) - group
    at = (base[:, None] + _PLACES[c]).ravel()
    padded = np.frombuffer(data + bytes(4), np.uint8)
    word = padded[at].astype(np.uint32)
    length = _LENGTHS[c].ravel()
    for k in (1, 2, 3):
        more = np.flatnonzero(length > k)
        word[more] |= padded[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return word[:n]


def tokenize(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit, or 16-bit where ``wide`` is false), wide."""
    bound_batches(docs.sparkSession)

    def run(batches):
        encoder = Encoder.of(vocabulary)
        for batch in gather(batches, text, 3 << 20):
            ids, n = encoder.encode(batch.column(text))
            ends = np.cumsum(n)
            blobs, wide = [], []
            for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
                own = ids[a:b]
                big = bool(own.max() > 0xFFFF)
                wide.append(big)
                blobs.append(own.astype("<u4" if big else "<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(doc_id).cast(pa.int64()), pa.array(n), pa.array(blobs, pa.binary()), pa.array(wide)], names=["doc_id", "n_tokens", "ids", "wide"])

    return docs.select(doc_id, text).mapInArrow(run, "doc_id long, n_tokens long, ids binary, wide boolean")


def _ids(blob: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(blob, "<u4" if wide else "<u2").astype(np.uint32)


def ranks(tokens: DataFrame) -> DataFrame:
    """id, n, rank: ids by falling frequency over all documents; at most one row per id of the vocabulary."""

    def run(batches):
        n = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for blob, wide in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.bincount(_ids(blob, wide))
                if len(own) > len(n):
                    n = np.concatenate([n, np.zeros(len(own) - len(n), np.int64)])
                n[: len(own)] += own
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["id", "n"])

    counts = tokens.select("ids", "wide").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # one row per id of the vocabulary, whatever the size of the corpus
    return counts.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "id")) - 1)


def write(tokens: DataFrame, path: str, block_ids: int = 1 << 18, part_ids: int = 16 << 20) -> None:
    """Write ids in the format above to path/blocks and path/ranks."""
    spark = tokens.sparkSession
    table = ranks(tokens)
    table.write.option("compression", "zstd").parquet(f"{path}/ranks")
    rows = spark.read.parquet(f"{path}/ranks").select("id", "rank", "n").collect()  # at most the vocabulary
    most = max((r["id"] for r in rows), default=0)
    rank = np.zeros(most + 1, np.uint32)
    for r in rows:
        rank[r["id"]] = r["rank"]
    sent = spark.sparkContext.broadcast(rank)  # at most the vocabulary
    total = sum(r["n"] for r in rows)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // part_ids))
    order = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    check = F.crc32("ids")

    def run(batches):
        table, number, held, n = sent.value, 0, [], 0

        def block():
            values = table[np.concatenate([_ids(b, w) for _, b, w in held])]
            control, data = pack(values)
            lengths = [len(b) // (4 if w else 2) for _, b, w in held]
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([[d for d, _, _ in held]], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([len(values)]), pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                names=["block", "doc_ids", "lengths", "n_ids", "control", "data"],
            )

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "wide")), strict=True):
                held.append(row)
                n += len(row[1])
                if n >= 2 * block_ids:
                    yield block()
                    number, held, n = number + 1, [], 0
        if held:
            yield block()

    sorted_ = tokens.repartitionByRange(parts, order, check).sortWithinPartitions(order, check).select("doc_id", "ids", "wide")
    blocks = sorted_.mapInArrow(run, "block long, doc_ids array<long>, lengths array<long>, n_ids long, control binary, data binary")
    blocks.withColumn("part", F.spark_partition_id()).write.option("compression", "zstd").parquet(f"{path}/blocks")


def read_back(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files."""
    blocks = spark.read.parquet(f"{path}/blocks")
    rows = spark.read.parquet(f"{path}/ranks").select("id", "rank").collect()  # at most the vocabulary
    back = np.zeros(len(rows), np.uint32)
    for r in rows:
        back[r["rank"]] = r["id"]
    sent = spark.sparkContext.broadcast(back)
    # where blocks begin: first over parts, then inside each part; a row per block, without its streams
    sizes = blocks.select("part", "block", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.withColumn("before", F.sum("n").over(W.orderBy("part")) - F.col("n"))
    inside = F.sum("n_ids").over(W.partitionBy("part").orderBy("block")) - F.col("n_ids")
    starts = sizes.withColumn("inside", inside).join(parts.select("part", "before"), "part").select("part", "block", (F.col("inside") + F.col("before")).alias("base"))

    def run(batches):
        table = sent.value
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("doc_ids", "lengths", "n_ids", "control", "data")}
                ids = table[unpack(row["control"], row["data"], row["n_ids"])].astype("<u4")
                n = np.array(row["lengths"], np.int64)
                ends = np.cumsum(n)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([batch.column(c)[k].as_py()] * len(n), pa.int64()) for c in ("part", "block")), pa.array(row["doc_ids"], pa.int64()), pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())],
                    names=["part", "block", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    decoded = blocks.select(F.col("part").cast("long").alias("part"), "block", "doc_ids", "lengths", "n_ids", "control", "data").mapInArrow(
        run, "part long, block long, doc_id long, at long, n_tokens long, ids_crc32 long"
    )
    return decoded.join(starts, ["part", "block"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_ids(spark, sf_dir):
    """Every document's place, length and checksum, decoded from the files written."""
    import uuid

    import public_tokenizers

    from .common import remember, shared_folder

    path = f"{shared_folder(spark)}/clickloom/token-ids-{uuid.uuid4().hex}"
    remember(spark, path)
    tokens = materialize(tokenize(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")), "tokens")
    write(tokens, path)
    return read_back(spark, path)
