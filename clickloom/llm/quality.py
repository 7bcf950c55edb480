"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every text. Expectation-maximisation over the counts of vote patterns (at most
3 to the number of labellers, whatever the corpus) estimates each labeller's accuracy: the chance that its vote is the text's class,
given that labellers err independently. Accuracies have a beta prior worth a share of the labeller's votes, since a labeller that
never meets another says nothing of itself; the classes are balanced beforehand, as silence is no evidence. The posterior
of a text's pattern is its label, and such labels train a hashed linear scorer on word shapes, which also judges texts on which
no labeller spoke.

Fitting the scorer reads at most ``most_rows`` different rows, smallest hashes of doc_id first; pattern counts cover all
texts, and scoring reads every text whole.

Defined cases: null texts and texts without words are rejected with score 0; repeated rows are judged alike; a text of any length is read whole; a corpus on which no
labeller tells classes apart is kept; an empty table gives no rows; extra columns are kept, but those
named like a result column give way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, gather, materialize, read, without
from .textnum import Spans, Words, whitespace_table

NONE, BAD, GOOD = 0, 1, 2
LABELLERS = ("symbols", "capitals", "exclamations", "columns", "repeats", "variety", "endless", "prose")
#: Prior accuracy of votes, and the share of a labeller's votes that it weighs.
PRIOR, WEIGHT = 0.9, 0.5
BITS = 14


def votes(words: Words) -> np.ndarray:
    """A row per text, a column per labeller."""
    raw, offsets, first = words.raw, words.offsets, words.first
    n = words.counts

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[offsets[1:]] - total[offsets[:-1]]

    def per_word(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[first[1:]] - total[first[:-1]]

    def is_in(chars: str) -> np.ndarray:
        table = np.zeros(256, bool)
        table[np.frombuffer(chars.encode(), np.uint8)] = True
        return table[raw]

    some = np.maximum(n, 1)
    upper = per_text((raw >= 65) & (raw <= 90))
    lower = per_text((raw >= 97) & (raw <= 122))
    symbols = per_text(is_in("#$%&*@^~=<>{}[]\\`")) / some
    shouts = per_text(raw == 33) / some
    bars = per_text(raw == 124) / some
    ends = per_text(is_in(".?!")) / some
    h = words.hashes()
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[words.first[:-1][n > 0]] = False
    again = per_word(same) / some
    order = np.lexsort((h, words.doc()))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (words.doc()[order][1:] != words.doc()[order][:-1])
    variety = per_word(new) / some  # order keeps the texts apart, so counts by place hold
    length = per_word(words.end - words.start) / some

    def bad(when: np.ndarray, enough: int) -> np.ndarray:
        return np.where(when & (n >= enough), BAD, NONE)

    calm = (symbols < 0.1) & (upper < 0.2 * (upper + lower)) & (shouts < 0.05) & (bars < 0.02) & (again < 0.05)
    prose = calm & (variety > 0.4) & (ends > 0.02) & (ends < 0.6) & (length > 3) & (length < 11) & (n >= 20)
    return np.stack(
        [
            bad(symbols > 0.4, 1),
            bad(upper > 0.5 * (upper + lower), 3),
            bad(shouts > 0.3, 3),
            bad(bars > 0.3, 2),
            bad(again > 0.3, 8),
            bad(variety < 0.15 + 0.6 / np.sqrt(some), 20),
            bad(ends < 0.003, 100),
            np.where(prose, GOOD, NONE),
        ],
        axis=1,
    ).astype(np.int8)


def code(v: np.ndarray) -> np.ndarray:
    return (v.astype(np.int64) * 3 ** np.arange(v.shape[1])).sum(1)


def decode(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def estimate(codes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of good for each pattern, and the accuracy of each labeller."""
    v = decode(codes)
    accuracy = np.full(v.shape[1], PRIOR)
    posterior = np.full(len(v), 0.5)
    for _ in range(rounds):
        weight = np.log(accuracy / (1 - accuracy))
        fresh = 1 / (1 + np.exp(-np.clip((v == GOOD) @ weight - (v == BAD) @ weight, -50, 50)))
        right = counts[:, None] * np.where(v == GOOD, fresh[:, None], np.where(v == BAD, 1 - fresh[:, None], 0))
        n = (counts[:, None] * (v != NONE)).sum(0)
        accuracy = np.clip((right.sum(0) + PRIOR * (WEIGHT * n + 1)) / ((1 + WEIGHT) * n + 1), 0.5, 0.999)
        if np.abs(fresh - posterior).max(initial=0) < 1e-9:
            break
        posterior = fresh
    return posterior, accuracy


def shapes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text and feature of every word: its shape (runs of capitals, letters and digits made one), and shapes after a repeat apart."""
    data = words.data.copy()
    kind = np.arange(256, dtype=np.uint8)
    kind[[*range(97, 123), *range(128, 256)]] = 97
    kind[65:91], kind[48:58] = 65, 48
    data = kind[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != data[:-1]) | (words.data[1:] == 0)
    keep[words.start] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    h = Spans(data[keep]).hashes(at[words.start], at[words.end])
    own = words.hashes()
    same = np.zeros(len(own), bool)
    same[1:] = own[1:] == own[:-1]
    h = np.where(same, h ^ np.uint64(0x5555555555555555), h)
    return words.doc(), (h & np.uint64((1 << BITS) - 1)).astype(np.int64)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, weight: np.ndarray, steps: int = 300, rate: float = 0.1, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on shares of features, by Adam; label is the probability of good."""
    row = np.repeat(np.arange(len(rows)), [len(k) for k, _ in rows])
    key = np.concatenate([*(k for k, _ in rows), np.empty(0, np.int64)]).astype(np.int64)
    value = np.concatenate([*(v for _, v in rows), np.empty(0)])
    w, b = np.zeros(1 << BITS), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    weight = weight / max(weight.sum(), 1e-9)
    for t in range(1, steps + 1):
        z = np.bincount(row, w[key] * value, minlength=len(rows)) + b
        d = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - label) * weight
        g = np.append(np.bincount(key, d[row] * value, minlength=len(w)) + decay * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def score(words: Words, w: np.ndarray, b: float) -> np.ndarray:
    doc, key = shapes(words)
    n = words.counts
    z = np.bincount(doc, w[key], minlength=len(n))[: len(n)] / np.maximum(n, 1) + b
    return np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0.0)


def train(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", most_rows: int = 4000) -> tuple[np.ndarray, float, dict]:
    """Weights and bias of the scorer, and what was estimated of the labellers."""
    spark = docs.sparkSession
    bound_batches(spark)

    def vote(batches):
        for batch in gather(batches, text):
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(code(votes(Words(batch.column(text), whitespace_table()))))], names=["id", "h", "pattern"])

    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias(text)).where(F.col(text).isNotNull())
    seen = materialize(rows.mapInArrow(vote, "id string, h long, pattern long"), "votes")
    counts = seen.groupBy("pattern").count().collect()  # at most 3 ** len(LABELLERS) rows
    codes, n = np.array([r["pattern"] for r in counts], np.int64), np.array([r["count"] for r in counts], float)
    posterior, accuracy = estimate(codes, n)
    known = dict(zip(codes.tolist(), posterior.tolist(), strict=True))
    report = {"accuracy": dict(zip(LABELLERS, accuracy.tolist(), strict=True)), "posterior": known}
    # a half of the sample from each side, as far as there are so many: the rarer class must be seen; silent texts teach nothing
    picked = [
        seen.where(F.col("pattern").isin(side) & F.col("id").isNotNull()).distinct().orderBy(F.xxhash64("id"), "id", "h").limit(most_rows // 2)
        for side in ([c for c, p in known.items() if p < 0.5], [c for c, p in known.items() if p > 0.5])
    ]

    def count(batches):
        for batch in gather(batches, text):
            words = Words(batch.column(text), whitespace_table())
            doc, key = shapes(words)
            pairs, n = np.unique(doc << BITS | key, return_counts=True)
            bounds = np.searchsorted(pairs >> BITS, np.arange(batch.num_rows + 1)).tolist()
            cuts = list(zip(bounds[:-1], bounds[1:], strict=True))
            key = (pairs & ((1 << BITS) - 1)).astype(np.int32)
            value = (n / np.maximum(words.counts, 1)[pairs >> BITS]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("pattern"), *(pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (key, value))], names=["pattern", "keys", "counts"])

    sample = F.broadcast(picked[0].unionByName(picked[1]))  # most_rows rows
    rows = rows.join(sample, ["id", "h"]).groupBy("id", "h").agg(F.first(text).alias(text), F.first("pattern").alias("pattern"))  # equal rows are one
    found = rows.select(text, "pattern").mapInArrow(count, "pattern long, keys binary, counts binary").collect()  # most_rows rows
    features = [(np.frombuffer(r["keys"], np.int32).astype(np.int64), np.frombuffer(r["counts"], np.float32).astype(float)) for r in found]
    label = np.array([known[r["pattern"]] for r in found])
    weight = np.where(label < 0.5, 1 / max((label < 0.5).sum(), 1), 1 / max((label >= 0.5).sum(), 1)) if len(label) else label
    w, b = fit(features, label, weight) if (label < 0.5).any() else (np.zeros(1 << BITS), 5.0)
    return w, b, report


def judge(docs: DataFrame, model: tuple, text: str = "text", keep_text: bool = True, least: float = 0.33) -> DataFrame:
    """docs with votes (labeller by labeller: 0 none, 1 bad, 2 good), posterior, score and kept.

    A text is kept if the mean of posterior and score is at least ``least``: a very short text has too few shapes for
    the scorer alone, and goes only where a labeller speaks against it.
    """
    docs = without(docs, "votes", "posterior", "score", "kept")
    w, b, report = model
    sent = docs.sparkSession.sparkContext.broadcast((w, b, report["posterior"]))
    kept = [c for c in docs.columns if keep_text or c != text]

    def run(batches):
        w, b, posterior = sent.value
        for batch in gather(batches, text):
            words = Words(batch.column(text), whitespace_table())
            v = votes(words)
            s = score(words, w, b)
            p = np.array([posterior.get(c, 0.5) for c in code(v).tolist()])
            columns = [pa.array(["".join(map(str, r)) for r in v.tolist()], pa.string()), pa.array(p, pa.float64()), pa.array(s), pa.array(((s + p) / 2 >= least) & (words.counts > 0))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=[*kept, "votes", "posterior", "score", "kept"])

    more = T.StructType.fromDDL("votes string, posterior double, score double, kept boolean")
    return docs.mapInArrow(run, T.StructType([*docs.select(*kept).schema.fields, *more.fields]))


def op6_quality(spark, sf_dir):
    """Every document with its votes, posterior, score and whether it is kept."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, train(docs), keep_text=False)
