"""Secret scans: fixed base patterns, plus formats inferred from the credentials that those find.

Grammar inference follows the ALERGIA scheme. Labelled credentials (the values of base matches, by kind) go
into a prefix tree over character classes; states whose outgoing and end frequencies agree within a Hoeffding bound are merged, red
states absorbing blue ones, with children folded in so that the automaton stays deterministic. The result is a probabilistic automaton for each
kind. A candidate is every maximal run of 6 or more credential characters with a letter among them; its format likelihood
is the best mean log-probability per character over the automata, against a background automaton inferred from ordinary words. A
candidate whose advantage reaches ``threshold`` becomes a span of kind ``learned``, unless a base span overlaps it. For candidates of n < 16
characters the threshold is (16 / n) ** 2 times higher, as short words reach a high mean by chance.
Runs without a letter are no candidates: card, phone and network numbers look like the digits of any format.

Training reads at most ``sample`` // 4 distinct labelled credentials of each kind and as many of all distinct ordinary words of all texts
(smallest hashes first, so a bounded sample that is the same for every layout of the rows); scanning covers every character of every text.

Defined cases: null text counts as empty; with no credentials to learn from nothing is learned and only base spans
are reported; a text of any length is scanned whole; repeated rows are scanned alike; an empty table gives no rows; extra columns are kept, but those named like a result column give way to it.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, gather, materialize, read, without
from .textnum import Words, signed, span_hashes

KINDS = ("assign", "access", "hex", "learned")
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: What a text must hold before the patterns above are tried, for a linear-time automaton.
HINT_ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)"
HINT_HEX = r"[0-9a-f]{24}"
FULL = 16  # characters from which the threshold holds as it is; for shorter candidates it grows with the square of what they lack
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
BACKGROUND = 4  # the kind of ordinary words in training
LONGEST = 512  # characters of a credential that training reads
MOST_KNOWN = 100_000  # patterns whose score a task keeps
LEAST_WORD = 4  # characters of an ordinary word


def base_spans(text: str, assign: bool = True, hexes: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches, in order; code points, end exclusive."""
    found = []
    if assign:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if hexes:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return sorted(found)


# Character classes: lower-case hex letters, other lower case, upper-case hex letters, other upper case, digits, each other character.
_CLASS = {}
for _c in map(chr, range(128)):
    if _c.isdigit():
        _CLASS[_c] = 0
    elif _c.islower():
        _CLASS[_c] = 1 if _c in "abcdef" else 2
    elif _c.isupper():
        _CLASS[_c] = 3 if _c in "ABCDEF" else 4
    else:
        _CLASS[_c] = 5
N_CLASSES = 6
END = N_CLASSES



def classes(value: str) -> list[int]:
    return [_CLASS.get(c, 5) for c in value]


class Automaton:
    """A deterministic probabilistic automaton; counts[s] holds arrivals by class and, last, ends."""

    def __init__(self, counts: np.ndarray, step: np.ndarray):
        self.counts, self.step = counts, step
        total = counts.sum(1, keepdims=True)
        # a class never seen in a state keeps a small probability and leaves for the sink, state 0 of no use: -1
        self.logp = np.log((counts + 0.05) / (total + 0.05 * counts.shape[1]))

    def score(self, value: list[int]) -> float:
        """Mean log-probability per character, its end left out: lengths differ among credentials of one kind."""
        state, total, unseen = 0, 0.0, math.log(0.01 / N_CLASSES)
        for c in value:
            if state < 0:
                total += unseen
                continue
            total += self.logp[state, c]
            state = self.step[state, c]
        return total / max(len(value), 1)


def infer(values: list[list[int]], alpha: float = 0.05) -> Automaton:
    """ALERGIA: merge compatible states of the prefix tree of the values.

    The tree is cut off where fewer than two values remain; what lies beyond is left to the merged states. So at each length it has at most
    half as many states as there are values.
    """
    counts, step = [[0] * (N_CLASSES + 1)], [[-1] * N_CLASSES]
    level = [(0, values)]  # the states of one length, and the values that reach each
    depth = 0
    while level:
        below = []
        for s, reach in level:
            split: dict[int, list] = {}
            for v in reach:
                split.setdefault(v[depth] if depth < len(v) else END, []).append(v)
            for c, some in split.items():
                counts[s][c] += len(some)
                if c != END and len(some) > 1:
                    step[s][c] = len(step)
                    below.append((len(step), some))
                    counts.append([0] * (N_CLASSES + 1))
                    step.append([-1] * N_CLASSES)
        level = below
        depth += 1
    factor = math.sqrt(0.5 * math.log(2 / alpha))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = sum(counts[a]), sum(counts[b])
            if not n or not m:
                continue
            bound = factor * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if any(abs(x / n - y / m) > bound for x, y in zip(counts[a], counts[b], strict=True)):
                return False
            todo += [(x, y) for x, y in zip(step[a], step[b], strict=True) if x >= 0 and y >= 0 and x != y]
        return True

    parent = {0: (None, None)}
    for s, row in enumerate(step):
        for c, t in enumerate(row):
            if t >= 0:
                parent[t] = (s, c)

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a == b:
                continue
            for k, n in enumerate(counts[b]):
                counts[a][k] += n
            for c, t in enumerate(step[b]):
                if t >= 0:
                    if step[a][c] < 0:
                        step[a][c] = t
                        parent[t] = (a, c)
                    else:
                        todo.append((step[a][c], t))

    red = [0]
    while True:
        blue = sorted({t for s in red for t in step[s] if t >= 0} - set(red))
        if not blue:
            break
        b = blue[0]
        for r in red:
            if compatible(r, b):
                s, c = parent[b]
                step[s][c] = r
                fold(r, b)
                break
        else:
            red.append(b)
    name = {s: k for k, s in enumerate(red)}
    return Automaton(np.array([counts[s] for s in red], float), np.array([[name.get(t, -1) for t in step[s]] for s in red]))


def least_words(held: dict[int, str], texts, most: int) -> None:
    """Add ordinary words of the texts to those held, by hash, so that the ``most`` smallest hashes of all distinct words stay."""
    words = Words(texts, word_table())
    long = np.flatnonzero(words.end - words.start >= LEAST_WORD)
    start, end = words.start[long], words.end[long]
    hashes = signed(span_hashes(words.data, start, end) >> np.uint64(1))
    if len(held) >= most:
        below = np.flatnonzero(hashes < max(held))
        hashes, start, end = hashes[below], start[below], end[below]
    some, at = np.unique(hashes, return_index=True)
    for h, k in zip(some[:most].tolist(), at[:most].tolist(), strict=True):
        held[h] = words.raw[start[k] : min(end[k], start[k] + LONGEST)].tobytes().decode()
    for h in sorted(held)[most:]:
        del held[h]


def word_table() -> np.ndarray:
    """Ordinary words are runs of A-Z, a-z, ., = and -."""
    table = np.zeros(256, np.uint8)
    for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz.=-":
        table[c] = c
    return table


def learn(docs: DataFrame, text: str = "text", sample: int = 6000) -> list[Automaton]:
    """One automaton for each base kind that has credentials, and last the one of ordinary long words."""
    bound_batches(docs.sparkSession)

    most = sample // 4

    def labelled(batches):
        ordinary: dict[int, str] = {}
        for batch in gather(batches, text):
            kinds, values = [], []
            for row, spans in _spans(batch.column(text)):
                for start, kind, end in spans:
                    kinds.append(kind)
                    values.append((ASSIGN.match(row, start)[2] if kind == 0 else row[start:end])[:LONGEST])
            least_words(ordinary, batch.column(text), most)
            yield rows_of(kinds, values, [None] * len(kinds))
        yield rows_of([BACKGROUND] * len(ordinary), list(ordinary.values()), list(ordinary))

    def rows_of(kinds, values, ranks):
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(values, pa.string()), pa.array(ranks, pa.int64())], names=["kind", "value", "rank"])

    found = materialize(docs.select(text).mapInArrow(labelled, "kind int, value string, rank long").distinct(), "credentials")
    rows = []
    for kind in (0, 1, 2, BACKGROUND):
        rows.append([classes(r.value) for r in found.where(F.col("kind") == kind).orderBy(F.coalesce("rank", F.xxhash64("value")), "value").limit(most).collect()])
    return [infer(v) for v in rows if v] if rows[3] and any(rows[:3]) else []


def _spans(texts):
    """(text, base spans) of the texts that have some."""
    texts = pc.fill_null(texts, "")
    assign = pc.match_substring_regex(texts, HINT_ASSIGN).to_numpy(zero_copy_only=False)
    access = pc.match_substring(texts, "AKIA").to_numpy(zero_copy_only=False)
    hexes = pc.match_substring_regex(texts, HINT_HEX).to_numpy(zero_copy_only=False)
    for k in np.flatnonzero(assign | access | hexes):
        row = texts[int(k)].as_py()
        if spans := base_spans(row, bool(assign[k]), bool(hexes[k])):
            yield row, spans


def scan(docs: DataFrame, text: str = "text", threshold: float = 0.35, sample: int = 6000, keep_text: bool = True) -> DataFrame:
    """docs with the column spans: array of (kind, start, end, score), ordered by start, then kind; score is null for base kinds."""
    docs = without(docs, "spans")
    automata = learn(docs, text, sample)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(automata)  # a few states a kind: bounded by the sample
    kept = [c for c in docs.columns if keep_text or c != text]
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        formats = sent.value
        known: dict[bytes, float] = {}
        for batch in gather(batches, text):
            texts = pc.fill_null(batch.column(text), "")
            assign = pc.match_substring_regex(texts, HINT_ASSIGN).to_numpy(zero_copy_only=False)
            access = pc.match_substring(texts, "AKIA").to_numpy(zero_copy_only=False)
            hexes = pc.match_substring_regex(texts, HINT_HEX).to_numpy(zero_copy_only=False)
            more = learned(texts, formats, threshold, known) if formats else {}
            out: list[list[dict]] = [[] for _ in range(len(texts))]
            for k in sorted({*np.flatnonzero(assign | access | hexes).tolist(), *more}):
                base = base_spans(texts[k].as_py(), bool(assign[k]), bool(hexes[k])) if assign[k] or access[k] or hexes[k] else []
                spans = [(s, kind, e, None) for s, kind, e in base]
                spans += [x for x in more.get(k, ()) if not any(s < x[2] and x[0] < e for s, _, e in base)]
                out[k] = [{"kind": KINDS[kind], "start": s, "end": e, "score": score} for s, kind, e, score in sorted(spans, key=lambda x: x[:3])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, kind_type)], names=[*kept, "spans"])

    schema = docs.select(*kept).schema
    for f in T.StructType.fromDDL("spans array<struct<kind:string,start:int,end:int,score:double>>").fields:
        schema = schema.add(f)
    return docs.mapInArrow(run, schema)


def candidate_table() -> np.ndarray:
    """Candidates are runs of credential characters; each counts as its class plus 1."""
    table = np.zeros(256, np.uint8)
    for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-":
        table[ord(c)] = _CLASS[c] + 1
    return table


def learned(texts: pa.Array, formats: list[Automaton], threshold: float, known: dict[bytes, float]) -> dict[int, list[tuple[int, int, int, float]]]:
    """By text, the candidates (start, kind, end, advantage) whose format likelihood beats the background.

    Every distinct pattern of classes of a batch is scored once; known holds the advantages, less what each length asks for, of short ones.
    """
    words = Words(texts, candidate_table())
    patterns, at = words.distinct()
    over = np.full(len(patterns), -np.inf)
    value = np.zeros(len(patterns))
    for k, pattern in enumerate(patterns.to_pylist()):
        score = known.get(pattern)
        if score is None:
            score = -np.inf
            if len(pattern) >= LEAST_ASSIGN and any(1 < c < 6 for c in pattern):
                kinds = [c - 1 for c in pattern]
                score = max(a.score(kinds) for a in formats[:-1]) - formats[-1].score(kinds)
            if len(pattern) <= 2 * FULL:
                if len(known) >= MOST_KNOWN:
                    known.clear()
                known[pattern] = score
        value[k] = score
        over[k] = score - threshold * max(FULL / len(pattern), 1) ** 2
    hit = np.flatnonzero(over[at] >= 0) if len(at) else np.empty(0, np.int64)
    points = np.concatenate([[0], np.cumsum((words.raw & 0xC0) != 0x80)])  # code points before each byte
    doc = words.doc()[hit]
    base = points[words.offsets[doc]]
    found: dict[int, list] = {}
    for d, s, e, x in zip(doc.tolist(), (points[words.start[hit]] - base).tolist(), (points[words.end[hit]] - base).tolist(), value[at[hit]].tolist(), strict=True):
        found.setdefault(d, []).append((s, 3, e, x))
    return found


def op4_secrets(spark, sf_dir):
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    base = F.filter("spans", lambda s: s["kind"] != "learned")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def n(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
