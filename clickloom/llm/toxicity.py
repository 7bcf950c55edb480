"""Toxicity by non-negative positive-unlabelled learning.

Features are the words of a text and their beginnings of 3 to 8 bytes, as 64-bit hashes (A-Z as a-z); a feature's value is
log2(1 + occurrences), so habits of word building count beside single words. The classifier is linear,
trained with numpy on confirmed toxic texts and on unlabelled texts, which hold toxic ones too. With class prior p the
risk of calling unlabelled texts negative is corrected by the positives: R = p R_P(+) + max(0, R_U(-) - p R_P(-)). When the
corrected negative part falls below zero, which only over-fitting can cause, the step goes against it (the non-negative
estimator of Kiryo and others). The bias is then set so that a score of ``CUT`` is the cut that serves best: the sample's parts, told apart by
content, are each scored by a model of the others, and over their outputs recall ** 2 / share of texts flagged, which
grows with the F-measure and needs no negatives (Lee and Liu), is made greatest. With n positives n / (n + ``TRUST``) of that shift is made.

Fitting reads bounded samples, smallest hashes of doc_id first: at most ``most_positive`` toxic texts and ``most_unlabelled``
texts of any label; labels come from rows outside the held-out fold alone, and no label, source, language or id is a feature. Of the features
of at least ``least_df`` positives the ``most_keys`` that differ most, in standard errors, from the class-prior-corrected negatives are kept. Scoring reads every text whole.

Defined cases: null and empty texts have no features and get the score of the bias; documents without a label are scored alike;
with no confirmed toxic text every score is next to 0; repeated rows are scored alike; a text of any length is read whole; a score of
CUT itself counts as toxic; an empty table gives no rows; extra columns are kept, but those named like a result column give way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, gather, read, without
from .textnum import Spans, Words, alnum_table

PREFIXES = (3, 4, 5, 6, 7, 8)
FOLDS, HELD_OUT = 3, 1
CUT = 0.7  # the score from which a text counts as toxic
PARTS, TRUST = 4, 400  # parts of the sample that find the cut, and the positives with which half of the shift is made


def features(texts):
    """Pieces of (text number, feature hash), one for words and one for each length of beginnings."""
    words = Words(texts, alnum_table())
    spans, doc, length = Spans(words.data), words.doc(), words.end - words.start
    yield doc, spans.hashes(words.start, words.end)
    for n in PREFIXES:
        longer = length > n
        # a beginning is no word: other hash
        yield doc[longer], ~spans.hashes(words.start[longer], words.start[longer] + n)


def counted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs and how often each occurs."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


class Model:
    """Sparse linear model over feature hashes."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(keys)
        self.keys, self.weights, self.bias = keys[order], weights[order], bias
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def hits(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (text number, key number) and the feature's value."""
        docs, at = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for doc, h in features(texts):
            some = np.flatnonzero(self.maybe[(h & np.uint64(0xFFFFF)).astype(np.int64)])
            if len(some) and len(self.keys):
                k = np.minimum(np.searchsorted(self.keys, h[some]), len(self.keys) - 1)
                right = self.keys[k] == h[some]
                docs.append(doc[some][right])
                at.append(k[right])
        doc, k, n = counted(np.concatenate(docs), np.concatenate(at))
        return doc, k, np.log2(1 + n)

    def score(self, texts) -> np.ndarray:
        doc, k, value = self.hits(texts)
        z = self.bias + np.bincount(doc, self.weights[k] * value, minlength=len(texts))[: len(texts)]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Rows:
    """Sparse rows: which key has which value."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], n_keys: int):
        self.n, self.n_keys = max(len(rows), 1), n_keys
        self.row = np.repeat(np.arange(len(rows)), [len(k) for k, _ in rows])
        self.key = np.concatenate([*(k for k, _ in rows), np.empty(0, np.int64)]).astype(np.int64)
        self.value = np.concatenate([*(v for _, v in rows), np.empty(0)])

    def pick(self, keys: np.ndarray) -> Rows:
        """Only these keys, numbered anew."""
        out = Rows([], len(keys))
        number = np.full(self.n_keys, -1)
        number[keys] = np.arange(len(keys))
        keep = number[self.key] >= 0
        out.n, out.row, out.key, out.value = self.n, self.row[keep], number[self.key[keep]], self.value[keep]
        return out

    def moments(self) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(self.key, self.value, self.n_keys) / self.n, np.bincount(self.key, self.value**2, self.n_keys) / self.n

    def outputs(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.key] * self.value, minlength=self.n)

    def gradient(self, d: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(self.key, d[self.row] * self.value, self.n_keys), d.sum()) / self.n


def choose(P: Rows, U: Rows, prior: float, least_df: int, most_keys: int) -> np.ndarray:
    """Keys whose mean among positives exceeds that among negatives most, in standard errors; the negatives' mean is the
    unlabelled mean less the positives' share of it."""
    (a, aa), (u, uu) = P.moments(), U.moments()
    mean, square = (np.maximum(x - prior * y, 0) / (1 - prior) for x, y in ((u, a), (uu, aa)))
    z = (a - mean) / np.sqrt((np.maximum(aa - a * a, 0) + np.maximum(square, 1e-9) + 1 / P.n) / P.n)
    z[np.bincount(P.key, minlength=P.n_keys) < least_df] = 0
    best = np.argsort(-z, kind="stable")[:most_keys]
    return np.sort(best[z[best] > 1.5])


def fit(P: Rows, U: Rows, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk with logistic loss."""
    w, b = np.zeros(P.n_keys), -2.0
    m, v = np.zeros(P.n_keys + 1), np.zeros(P.n_keys + 1)

    def sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    for t in range(1, steps + 1):
        zp, zu = P.outputs(w) + b, U.outputs(w) + b
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_negative = U.gradient(sigmoid(zu)) - prior * P.gradient(sigmoid(zp))
        g = prior * P.gradient(sigmoid(zp) - 1) + g_negative if negative >= 0 else -g_negative
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def parts_of(rows: list[tuple[np.ndarray, np.ndarray]]) -> list[list]:
    """Rows by the sum of their keys: equal texts, confirmed or not, lie in the same part."""
    return [[r for r in rows if int(r[0].sum()) % PARTS == k] for k in range(PARTS)]


def best_cut(zp: np.ndarray, zu: np.ndarray) -> float:
    """The output from which on recall ** 2 / share of unlabelled texts is greatest, half-way down to the next output."""
    at = np.unique(zp)
    recall = 1 - np.searchsorted(np.sort(zp), at) / len(zp)
    flagged = len(zu) - np.searchsorted(np.sort(zu), at)
    best = at[np.argmax(recall**2 / np.maximum(flagged, 1))]
    below = np.concatenate([zp, zu])
    below = below[below < best]
    return float((best + below.max()) / 2 if len(below) else best)


def calibrated(positive: list, unlabelled: list, n_keys: int, prior: float, least_df: int, most_keys: int, bias: float) -> float:
    """The bias with which the best cut of the outputs has the score CUT; the given one if a part holds no positive or no unlabelled text."""
    p, u = parts_of(positive), parts_of(unlabelled)
    if not (all(p) and all(u)):
        return bias
    zp, zu = [], []
    for k in range(PARTS):
        P, U = (Rows([r for j in range(PARTS) if j != k for r in x[j]], n_keys) for x in (p, u))
        chosen = choose(P, U, prior, min(least_df, P.n), most_keys)
        w, b = fit(P.pick(chosen), U.pick(chosen), prior)
        zp.append(Rows(p[k], n_keys).pick(chosen).outputs(w) + b)
        zu.append(Rows(u[k], n_keys).pick(chosen).outputs(w) + b)
    shift = float(np.log(CUT / (1 - CUT))) - best_cut(np.concatenate(zp), np.concatenate(zu))
    return bias + shift * len(positive) / (len(positive) + TRUST)


def held_out(doc_id="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most_positive: int = 1000, most_unlabelled: int = 4000, least_df: int = 3, most_keys: int = 200) -> Model:
    bound_batches(docs.sparkSession)
    known = labels.where(~held_out()).where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rates = known.agg(F.avg("toxic").alias("p"), F.min("toxic").alias("least")).first()
    if rates.p is None or rates.p <= 0:
        return Model(np.empty(0, np.uint64), np.empty(0), -60.0)
    prior = float(rates.p) if rates.least == 0 else 0.1
    text = docs.select("doc_id", "text").where("text is not null")

    def first(rows: DataFrame, n: int) -> DataFrame:
        return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)

    # which documents: ids first, so that texts are neither sorted nor gathered
    toxic = first(known.where("toxic = 1").select("doc_id"), most_positive)
    sample = first(docs.select("doc_id").where("doc_id is not null").distinct(), most_unlabelled)

    def every(batches):
        for batch in gather(batches, "text"):
            pieces = list(features(batch.column("text")))
            doc, h, n = counted(np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces]))
            bounds = np.searchsorted(doc, np.arange(batch.num_rows + 1)).tolist()
            cuts = list(zip(bounds[:-1], bounds[1:], strict=True))
            value = np.log2(1 + n).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (h, value)], names=["keys", "counts"])

    def of(ids: DataFrame) -> DataFrame:
        """One text for each of the ids: of several the one with the least hash."""
        return text.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text")

    found = of(toxic).mapInArrow(every, "keys binary, counts binary").collect()  # most_positive rows
    lists = [(np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["counts"], np.float32)) for r in found]
    keys, df = np.unique(np.concatenate([*(k for k, _ in lists), np.empty(0, np.uint64)]), return_counts=True)
    keys = keys[df >= min(least_df, max(len(lists), 1))]
    positive = []
    for k, v in lists:
        known_ = np.isin(k, keys, assume_unique=True)
        positive.append((np.searchsorted(keys, k[known_]), v[known_].astype(float)))
    probe = docs.sparkSession.sparkContext.broadcast(Model(keys, np.zeros(len(keys)), 0.0))  # features of most_positive rows

    def some(batches):
        for batch in gather(batches, "text"):
            doc, k, value = probe.value.hits(batch.column("text"))
            bounds = np.searchsorted(doc, np.arange(batch.num_rows + 1)).tolist()
            cuts = list(zip(bounds[:-1], bounds[1:], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (k.astype(np.int32), value.astype(np.float32))], names=["keys", "counts"])

    rows = of(sample).mapInArrow(some, "keys binary, counts binary").collect()  # most_unlabelled rows
    unlabelled = [(np.frombuffer(r["keys"], np.int32).astype(np.int64), np.frombuffer(r["counts"], np.float32).astype(float)) for r in rows]
    P, U = Rows(positive, len(keys)), Rows(unlabelled, len(keys))
    chosen = choose(P, U, prior, min(least_df, max(len(lists), 1)), most_keys)
    weights, bias = fit(P.pick(chosen), U.pick(chosen), prior)
    return Model(keys[chosen], weights, calibrated(positive, unlabelled, len(keys), prior, least_df, most_keys, bias))


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with the column score, 0 to 1; higher: toxic likelier."""
    docs = without(docs, "score")
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most most_keys features
    kept = [c for c in docs.columns if keep_text or c != text]

    def run(batches):
        for batch in gather(batches, text):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sent.value.score(batch.column(text)))], names=[*kept, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.select(*kept).schema.fields, T.StructField("score", T.DoubleType())]))


def op7_toxicity(spark, sf_dir):
    """Every document with its fold, score and prediction; trained on labels outside the held-out fold."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, read(spark, sf_dir, "labels")), keep_text=False)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
