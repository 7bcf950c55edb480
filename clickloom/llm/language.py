"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its subwords: of every word (a run of letters; A-Z as a-z) the word itself with an edge mark
at either end and its runs of 1 to 4 bytes, edge marks included, hashed to ``BUCKETS`` rows. ``BLANK`` further subwords that say
nothing count in every average, so that short texts give weaker scores. The average times the class weights gives a logit a
language. Embeddings and weights are trained together by stochastic gradient descent in numpy. Rows that were never trained stay as
they began, at zero, so unknown subwords only weaken what the known ones say.

Scores are calibrated: a part of the sample is held back from the fit, told apart by content, and on it one temperature is chosen by
likelihood, with smoothed targets (n right answers do not make certain). There too the rejection limit is found, the lowest
score from which on accepted texts are wrong at most ``error`` of the time; texts below it are marked rejected and keep their best guess.

Fitting reads a bounded sample of labelled rows, the ``each`` smallest hashes of doc_id of each of the ``most_languages`` most frequent
languages, each text whole. Scoring reads every text whole: as all is linear, a batch's distinct words are embedded once.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; so is every text if nothing was learned. A text whose
subwords are all unknown gets the most likely language without evidence, with the score that this has. Rows without a doc_id or lang teach
nothing but are scored; repeated rows are scored alike; of several texts with one doc_id one teaches. Ties go to the language that comes first in order.
Extra columns are kept, but those named like a result column give way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, gather, inner, read, without
from .textnum import SPACE, Words, rolling

BUCKETS = 1 << 15
LENGTHS = (1, 2, 3, 4)
BLANK = 16
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
EDGE = 1  # a byte that no word holds


def _letters() -> np.ndarray:
    """Words are runs of A-Z (as a-z), a-z and non-ASCII characters."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = SPACE
    return table


def subwords(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every subword of each of the distinct words."""
    n = len(words)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1] if n else np.zeros(1, np.int64)
    length = np.diff(offsets) + 2
    start = np.cumsum(length) - length
    data = np.full(length.sum(), EDGE, np.uint8)
    word = np.repeat(np.arange(n), length)
    inside = np.ones(len(data), bool)
    inside[start], inside[start + length - 1] = False, False
    if n:
        data[inside] = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    end = start + length
    owner, bucket = [], []
    for k in LENGTHS:
        h = rolling(data.astype(np.uint64), k)
        fits = np.arange(len(h)) + k <= end[word[: len(h)]]
        owner.append(word[: len(h)][fits])
        bucket.append(h[fits])
    long = np.flatnonzero(length > max(LENGTHS))  # shorter ones are a run already
    if len(long):
        place = np.arange(len(data)) - start[word]
        with np.errstate(over="ignore"):
            mixed = (data.astype(np.uint64) + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03))
            mixed ^= mixed >> np.uint64(29)
            total = np.add.reduceat(mixed, start)
        owner.append(long)
        bucket.append(total[long] * np.uint64(0xBF58476D1CE4E5B9))
    return np.concatenate(owner), (np.concatenate(bucket) >> np.uint64(40)).astype(np.int64) % BUCKETS


class Model:
    """Languages, the logit that each bucket adds to each of them (its embedding times the class weights), and the calibration."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0, limit: float = 0.0):
        self.languages, self.table, self.bias, self.temperature, self.limit = languages, table, bias, temperature, limit

    def logits(self, texts: pa.Array) -> np.ndarray:
        words = Words(texts, _letters())
        out = np.tile(self.bias, (len(texts), 1))
        if not len(words):
            return out
        distinct, at = words.distinct()
        owner, bucket = subwords(distinct)
        many = np.bincount(owner, minlength=len(distinct)).astype(float)
        doc = words.doc()
        n = np.bincount(doc, many[at], minlength=len(texts)) + BLANK
        for k in range(len(self.languages)):
            sums = np.bincount(owner, self.table[bucket, k], minlength=len(distinct))
            out[:, k] += np.bincount(doc, sums[at], minlength=len(texts)) / n
        return out

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of the best language and its calibrated share."""
        p = softmax(self.logits(texts) / self.temperature)
        return p.argmax(1), p.max(1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def counted(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The buckets of each text and how often each occurs in it."""
    words = Words(texts, _letters())
    if not len(words):
        return [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in range(len(texts))]
    distinct, at = words.distinct()
    owner, bucket = subwords(distinct)
    order = np.argsort(owner, kind="stable")
    bucket, cut = bucket[order], np.searchsorted(owner[order], np.arange(len(distinct) + 1))
    found = []
    for d in range(len(texts)):
        own, n = np.unique(at[words.first[d] : words.first[d + 1]], return_counts=True)
        width = cut[own + 1] - cut[own]
        place = np.repeat(cut[own] - (np.cumsum(width) - width), width) + np.arange(width.sum())
        total = np.bincount(bucket[place], np.repeat(n, width), minlength=BUCKETS) if len(own) else np.zeros(BUCKETS)
        some = np.flatnonzero(total)
        found.append((some, total[some].astype(np.int64)))
    return found


def fit(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, classes: int, size: int = 16, epochs: int = 3, rate: float = 4.0, batch: int = 32, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Logit of each bucket for each class, and the bias, by stochastic gradient descent on embeddings and class weights.

    Rows are (bucket, count); the step falls linearly to zero. Classes count alike, however many rows each has.
    """
    rng = np.random.default_rng(seed)
    embedding, weights, bias = np.zeros((BUCKETS, size)), rng.normal(scale=size**-0.5, size=(size, classes)), np.zeros(classes)
    share = np.maximum(np.bincount(target, minlength=classes), 1)
    worth = share.sum() / (np.count_nonzero(np.bincount(target, minlength=classes)) * share)
    steps, t = epochs * -(-len(rows) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            key = np.concatenate([rows[r][0] for r in own])
            value = np.concatenate([rows[r][1] / (rows[r][1].sum() + BLANK) for r in own])
            row = np.repeat(np.arange(len(own)), [len(rows[r][0]) for r in own])
            start = np.searchsorted(row, np.arange(len(own)))
            average = np.zeros((len(own), size))
            some = np.flatnonzero(np.bincount(row, minlength=len(own)))
            if len(key):
                average[some] = np.add.reduceat(embedding[key] * value[:, None], start[some], axis=0)
            error = softmax(average @ weights + bias)
            error[np.arange(len(own)), target[own]] -= 1
            error *= worth[target[own], None] / len(own)
            step = rate * (1 - t / steps)
            back = error @ weights.T
            distinct, at = np.unique(key, return_inverse=True)
            for j in range(size):
                embedding[distinct, j] -= step * len(own) * np.bincount(at, back[row, j] * value, minlength=len(distinct))
            weights -= step * average.T @ error
            bias -= step * 0.01 * error.sum(0)
            t += 1
    return embedding @ weights, bias


def calibrate(logits: np.ndarray, target: np.ndarray, error: float = 0.01) -> tuple[float, float]:
    """The temperature of greatest likelihood, and the lowest score from which on at most the share ``error`` is wrong."""
    if not len(target):
        return 1.0, 0.0
    grid, classes = 2.0 ** np.arange(-5, 5.01, 0.125), logits.shape[1]
    smooth = np.full(logits.shape, 1 / (len(target) + classes))
    smooth[np.arange(len(target)), target] += len(target) / (len(target) + classes)
    loss = [-(smooth * np.log(np.maximum(softmax(logits / t), 1e-300))).sum(1).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = softmax(logits / temperature)
    score, wrong = p.max(1), p.argmax(1) != target
    order = np.argsort(-score, kind="stable")
    share = np.cumsum(wrong[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero((share <= error) & np.append(score[order][1:] != score[order][:-1], True))  # whole ties
    return temperature, float(score[order][fine[-1]]) if len(fine) else 1.0


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def train(docs: DataFrame, each: int = 400, most_languages: int = 64, parts: int = 5) -> Model:
    """A model of docs (doc_id, text, lang), without the rows held out."""
    spark = docs.sparkSession
    bound_batches(spark)
    known = docs.where("doc_id is not null and lang is not null and text is not null").where(~held_out())
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()  # most_languages rows
    languages = sorted(r.lang for r in counts)
    if not languages:
        return Model([], np.empty((BUCKETS, 0)), np.empty(0))
    # ids first, so that texts are not sorted; of each language only hashes low enough for some twice as many as wanted are ranked
    low = F.lit(-(1 << 63))
    for r in counts:
        share = min(1.0, (2 * each + 100) / r.n)
        low = F.when(F.col("lang") == r.lang, F.lit(min(int(share * (1 << 64)), (1 << 64) - 1) - (1 << 63))).otherwise(low)
    order = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = known.select("doc_id", "lang").where(F.col("lang").isin(*languages) & (F.xxhash64("doc_id") <= low)).withColumn("k", order).where(F.col("k") <= each).select("doc_id", "lang").distinct()
    text = known.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"])  # at most each * most_languages rows
    text = text.groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def features(batches):
        for batch in gather(batches, "text"):
            found = counted(batch.column("text"))
            columns = [batch.column("lang"), pa.array([k.astype(np.int32).tobytes() for k, _ in found], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "keys", "counts"])

    rows = text.select("lang", "text").mapInArrow(features, "lang string, keys binary, counts binary").collect()  # at most each * most_languages rows of BUCKETS pairs
    data = sorted((r.lang, bytes(r["keys"]), bytes(r["counts"])) for r in rows)  # in an order that does not depend on partitions
    number = {x: k for k, x in enumerate(languages)}
    target = np.array([number[d[0]] for d in data])
    pairs = [(np.frombuffer(d[1], np.int32).astype(np.int64), np.frombuffer(d[2], np.int32).astype(np.int64)) for d in data]
    back = np.array([int((k * (n % 1009 + 1)).sum()) % parts == 0 for k, n in pairs], bool)  # by content: equal texts lie on one side
    if back.all() or not back.any():
        back[:] = False

    def learn(use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return fit([pairs[k] for k in use], target[use], len(languages))

    table, bias = learn(np.flatnonzero(~back))
    seen = np.array([bias + (table[k] * n[:, None]).sum(0) / (n.sum() + BLANK) for k, n in (pairs[i] for i in np.flatnonzero(back))]).reshape(-1, len(languages))
    temperature, limit = calibrate(seen, target[back])
    return Model(languages, table, bias, temperature, limit)


def identify(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with lang_pred, score and rejected."""
    docs = without(docs, "lang_pred", "score", "rejected")
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS times the number of languages
    p = inner(docs)
    kept = [c for c in docs.columns if keep_text or c != text]
    marked = docs.withColumn(f"{p}letter", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))

    def run(batches):
        m = sent.value
        for batch in gather(batches, text, 6 << 20):
            letter = batch.column(f"{p}letter").to_numpy(zero_copy_only=False)
            if m.languages:
                best, score = m.predict(batch.column(text))
            else:
                best, score, letter = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            names = pa.array([*m.languages, UNKNOWN]).take(pa.array(np.where(letter, best, len(m.languages))))
            score = np.where(letter, score, 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), names, pa.array(score), pa.array(~letter | (score < m.limit))], names=[*kept, "lang_pred", "score", "rejected"])

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return marked.mapInArrow(run, T.StructType([*docs.select(*(F.col(f"`{c}`") for c in kept)).schema.fields, *fields]))


def op13_language(spark, sf_dir):
    """Every document with its fold, language and score; trained on the rows that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), train(docs), keep_text=False)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
