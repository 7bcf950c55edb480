"""Spelling variants: words that differ by one inserted, deleted or replaced code point, grouped under their frequent forms.

Words are looked up in minimal acyclic automata whose states know how many words lie beyond them, so that a walk ends with the word's number in
order (a perfect hash). A forward automaton holds the words, a backward one holds them reversed. Of two words one error apart, the
half without the error is matched exactly, the first half forward or the second half backward, and the other half is completed with
one error; a pair that both directions find (an insertion beside equal letters at the middle) counts where the first difference lies.

The vocabulary is spread over tasks by those exact halves: a word of L code points goes to the groups of its two halves, and, as a word
one longer, to those of words of L - 1. Groups are packed by hash, and a task builds one automaton for its groups of one length and direction. A
group of more than ``most`` words is split, however often the half occurs: the half with the error is halved again, and words
meet in groups that agree on all but a quarter (errors away from the start are looked up forward), and so on down to a single place, where a group can hold no more words than there are letters
(squared for the longer ones). Tasks send back, for each word, the number of its near words and the most frequent of them, never pairs.

Counting words reads every text whole, in batches, and sends a row for each distinct word of a batch. With ``one_in`` every run h of which that
number divides the crc32 of '<doc_id>:<run>' loses its code point at crc32 % length (planted misspellings); the crc32 of all
runs of a batch is put together from those of ids and distinct words.

Defined cases: null and empty texts have no words; a row without a doc_id loses no code point; repeated rows count again; runs of any length are words;
an empty table gives no rows; ties of frequency go to the smaller word in code-point order; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import bound_batches, gather, materialize, read
from .textnum import mix

SHIFTED = 64  # lengths in bytes for which crc32 values are moved by table
_LETTER = np.zeros(256, np.uint8)
_LETTER[97:123] = _LETTER[65:91] = np.arange(97, 123)
_BITS = np.uint64(21)  # a code point fits


def runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The letters of the texts, a byte each (A-Z as a-z, U+00C0 to U+00FF as themselves), and text, start and end of every maximal run."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    code, lead = _LETTER[data], data == 0xC3
    after = np.flatnonzero(lead) + 1  # U+00C0 to U+00FF are 0xC3 and one byte from 0x80 to 0xBF
    code[after] = data[after] + 0x40
    kept = np.concatenate([[0], np.cumsum(~lead)])
    code, offsets = code[~lead], kept[offsets - offsets[0]]
    edge = np.zeros(len(code) + 1, bool)
    edge[offsets] = True
    letter = code > 0
    before, behind = np.append(False, letter[:-1])[: len(code)], np.append(letter[1:], False)[: len(code)]
    start = np.flatnonzero(letter & (~before | edge[:-1]))
    end = np.flatnonzero(letter & (~behind | edge[1:])) + 1
    return code, np.searchsorted(offsets, start, side="right") - 1, start, end


def _crc_tables() -> np.ndarray:
    """[length, byte, value]: what the bytes of a crc32 add up to after so many further bytes."""
    step = np.array([zlib.crc32(bytes([v])) for v in range(256)], np.uint32)
    step ^= step[0]  # without the inversions: the move by one zero byte
    out = np.zeros((SHIFTED + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(SHIFTED):
        out[n + 1] = (out[n] >> np.uint32(8)) ^ step[out[n] & np.uint32(255)]
    return out


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """crc32 of a text and another of ``length`` bytes (at most SHIFTED) behind it, from the two crc32."""
    out = second.copy()
    for k in range(4):
        out ^= tables[length, k, (first >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, one_in: int | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(word, n): runs of letters of at least least_length code points and how often they occur."""
    bound_batches(docs.sparkSession)
    tables = _crc_tables()

    def count(batches):
        for batch in gather(batches, "text", 4 << 20):
            code, doc, start, end = runs(batch.column("text"))
            offsets = np.concatenate([[0], np.cumsum(end - start)])
            coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(code[code > 0])]).dictionary_encode()
            at, words = coded.indices.to_numpy(), [w.decode("latin-1") for w in coded.dictionary.to_pylist()]
            more: Counter = Counter()
            if one_in:
                raw = [w.encode() for w in words]
                size = np.array([len(r) for r in raw], np.int64)
                crc = np.array([zlib.crc32(r) for r in raw], np.uint32)
                ids = batch.column("id").to_pylist()
                own = np.array([0 if i is None else zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
                named = np.array([i is not None for i in ids], bool)
                h = joined_crc(own[doc], crc[at], np.minimum(size[at], SHIFTED), tables) if len(at) else np.empty(0, np.uint32)
                for k in np.flatnonzero(size[at] > SHIFTED).tolist():  # few
                    h[k] = zlib.crc32(raw[at[k]], int(own[doc[k]]))
                hit = (h % np.uint32(one_in) == 0) & named[doc]
                for k, x in zip(at[hit].tolist(), h[hit].tolist(), strict=True):  # one in one_in
                    w = words[k]
                    more[w[: x % len(w)] + w[x % len(w) + 1 :]] += 1
                at = at[~hit]
            n = np.bincount(at, minlength=len(words))
            some = np.flatnonzero((n > 0) & (np.array([len(w) for w in words], np.int64) >= least_length))
            more = {w: k for w, k in more.items() if len(w) >= least_length}
            yield pa.RecordBatch.from_arrays([pa.array([*(words[k] for k in some.tolist()), *more], pa.string()), pa.array([*n[some].tolist(), *more.values()], pa.int64())], names=["word", "n"])

    found = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text")).where("text is not null").mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Automaton:
    """The minimal acyclic automaton of sorted, distinct, zero-padded rows of code points. A row's number is its place in that order."""

    def __init__(self, codes: np.ndarray):
        n, width = codes.shape
        length = (codes != 0).sum(1)
        shared = np.full(n, -1)  # letters shared with the row before
        if n > 1:
            shared[1:] = (codes[1:] != codes[:-1]).argmax(1)
        node, nodes = np.zeros(n, np.int64), 1
        parent, letter, level = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [1]
        final = [np.array([bool(n) and length[0] == 0])]
        for d in range(1, width + 1):  # a tree first, level by level
            rows = np.flatnonzero(length >= d)
            if not len(rows):
                break
            fresh = shared[rows] < d
            own = nodes + np.cumsum(fresh) - 1
            parent.append(node[rows[fresh]])
            letter.append(codes[rows[fresh], d - 1].astype(np.int64))
            ends = np.zeros(int(fresh.sum()), bool)
            ends[own[length[rows] == d] - nodes] = True
            final.append(ends)
            level.append(len(ends))
            node[rows] = own
            nodes += len(ends)
        parent, letter, final = np.concatenate(parent), np.concatenate(letter), np.concatenate(final)
        height, bounds = np.zeros(nodes, np.int64), np.cumsum([0, *level])
        for d in range(len(level) - 1, 0, -1):
            at = slice(bounds[d], bounds[d + 1])
            np.maximum.at(height, parent[at], height[at] + 1)
        self._merge(parent, letter, final, height)

    def _merge(self, parent: np.ndarray, letter: np.ndarray, final: np.ndarray, height: np.ndarray) -> None:
        """Nodes with the same words beyond them become one state, from the ends of the words up."""
        nodes = len(parent)
        state, one, two = np.zeros(nodes, np.int64), np.zeros(nodes, np.uint64), np.zeros(nodes, np.uint64)
        order, states = np.argsort(height, kind="stable"), 0
        cut = np.searchsorted(height[order], np.arange(height.max() + 2))
        chosen, count = [], np.zeros(nodes, np.int64)
        below = np.zeros(nodes, np.int64)  # words beyond a node
        for h in range(len(cut) - 1):
            own = order[cut[h] : cut[h + 1]]
            below[own] += final[own]
            rank = np.lexsort((final[own], two[own], one[own]))
            own = own[rank]
            new = np.ones(len(own), bool)
            new[1:] = (one[own[1:]] != one[own[:-1]]) | (two[own[1:]] != two[own[:-1]]) | (final[own[1:]] != final[own[:-1]])
            state[own] = states + np.cumsum(new) - 1
            chosen.append(own[new])
            states += int(new.sum())
            child = own[own > 0]
            edge = (state[child].astype(np.uint64) << _BITS) | letter[child].astype(np.uint64)
            np.add.at(one, parent[child], mix(edge + np.uint64(1)))  # 128 bits of the set of edges
            np.add.at(two, parent[child], mix(edge ^ np.uint64(0x9E6C63D0876A46E5)))
            np.add.at(below, parent[child], below[child])
        chosen = np.concatenate(chosen)
        number = np.full(nodes, -1)
        number[chosen] = np.arange(states)
        edges = np.flatnonzero(number[parent] >= 0)
        edges = edges[edges > 0]
        key = (number[parent[edges]] << int(_BITS)) | letter[edges]
        edges, key = edges[np.argsort(key)], np.sort(key)
        self.root, self.final, self.key = state[0], final[chosen], key
        self.letter, self.to, count = letter[edges], state[edges], below[edges]
        self.first = np.searchsorted(key, np.arange(states + 1) << int(_BITS))
        source = number[parent[edges]]
        total = np.cumsum(count) - count
        self.skipped = total - total[self.first[source]] + self.final[source]  # words before those of an edge

    def step(self, at: tuple, letters: np.ndarray) -> tuple[tuple, np.ndarray]:
        """(query, state, number) after one more letter of each, and which went on."""
        query, state, number = at
        key = (state << int(_BITS)) | letters
        e = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        alive = self.key[e] == key if len(self.key) else np.zeros(len(key), bool)
        e = e[alive]
        return (query[alive], self.to[e], number[alive] + self.skipped[e]), alive

    def one_error(self, words: np.ndarray, a: int, b: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Replaced and inserted: (word, number found) where places a to b - 1 of words of this automaton hold the first difference (also the end, if b is)."""
        m, size = words.shape
        words = words.astype(np.int64)
        exact = (np.arange(m), np.full(m, self.root), np.zeros(m, np.int64))
        replaced = inserted = tuple(np.empty(0, np.int64) for _ in range(3))
        for p in range(size + 1):
            open_ = a <= p < b or p == b == size
            if open_:
                _, state, number = exact
                width = self.first[state + 1] - self.first[state]
                q = np.repeat(np.arange(m), width)
                e = np.arange(len(q)) - np.repeat(np.cumsum(width) - width - self.first[state], width)
                if p < size:
                    other = self.letter[e] != words[q, p]
                    q, e = q[other], e[other]
                fresh = (q, self.to[e], number[q] + self.skipped[e])
                inserted = _both(inserted, fresh)
            if p < size:
                inserted, _ = self.step(inserted, words[inserted[0], p])
                replaced, _ = self.step(replaced, words[replaced[0], p])
                if open_:
                    replaced = _both(replaced, fresh)
                exact, _ = self.step(exact, words[:, p])
        return tuple((q[f], x[f]) for q, s, x in (replaced, inserted) for f in (self.final[s],))


def _both(a: tuple, b: tuple) -> tuple:
    return tuple(np.concatenate(x) for x in zip(a, b, strict=True))


def _reversed(codes: np.ndarray) -> np.ndarray:
    length = (codes != 0).sum(1)
    place = length[:, None] - 1 - np.arange(codes.shape[1])
    return np.where(place >= 0, np.take_along_axis(codes, np.maximum(place, 0), 1), 0)


def near_in_group(words: list[str], n: np.ndarray, base: int, a: np.ndarray, b: np.ndarray, backward: bool):
    """(distinct words in order, near words of each, frequency and index of the most frequent near word).

    Rows are words of base code points and of one more; near pairs count whose first difference lies in a row's own range a to b. Backward serves
    ranges from 0 only: elsewhere a letter inserted beside its equals may have its last place before a.
    """
    texts, first, at = np.unique(np.array(words, dtype=f"U{base + 1}"), return_index=True, return_inverse=True)
    codes, n = texts.view(np.uint32).reshape(len(texts), base + 1), n[first]
    query = np.flatnonzero(codes[at, base] == 0)
    if backward:
        turned = _reversed(codes)
        order = np.argsort(np.ascontiguousarray(turned).view(f"U{base + 1}").ravel(), kind="stable")
        held, automaton = turned, Automaton(turned[order])
    else:
        order, held, automaton = np.arange(len(texts)), codes, Automaton(codes)
    of, other = [], []
    for low, high in sorted(set(zip(a[query].tolist(), b[query].tolist(), strict=True))):
        own = at[query[(a[query] == low) & (b[query] == high)]]
        (q, x), (r, y) = automaton.one_error(held[own, :base], *((base - high, base - low) if backward else (low, high)))
        u, v = own[q], order[x]
        s, t = own[r], order[y]
        if backward:
            keep = np.concatenate([*(_first_difference(codes[s[k : k + 65536]], codes[t[k : k + 65536]], base) for k in range(0, len(s), 65536)), np.empty(0, np.int64)])
            keep = (keep >= low) & ((keep < high) | (high == base))
            s, t = s[keep], t[keep]
        of += [u, s, t]
        other += [v, t, s]
    of, other = (np.concatenate([*x, np.empty(0, np.int64)]) for x in (of, other))
    order = np.lexsort((other, -n[other], of))
    of, other = of[order], other[order]
    lead = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
    return texts[of[lead]], np.diff(np.append(lead, len(of))), n[other[lead]], texts[other[lead]]


def _first_difference(x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    differ = x[:, :size] != y[:, :size]
    return np.where(differ.any(1), differ.argmax(1), size)


def near_words(words: DataFrame, most: int = 50_000, task_words: int = 100_000) -> DataFrame:
    """(word, n_near, best_n, best): how many of words (word, n; distinct) are near, and the most frequent of them; words without any have no row."""
    bound_batches(words.sparkSession)
    size = F.length("word")

    def ranges(base):
        half = F.floor(base / 2).cast("int")
        return [F.struct(base.alias("base"), a.cast("int").alias("a"), b.cast("int").alias("b")) for a, b in ((F.lit(0), half), (half, base))]

    every = words.select("word", "n", F.explode(F.array(*ranges(size), *ranges(size - 1))).alias("r")).select("word", "n", "r.*").where("base > 0")
    key = F.expr("xxhash64(base, a, b, left(word, a), right(word, base - b))")
    level, done = every, None
    while True:
        level = materialize(level.withColumn("key", key), "word-groups")
        groups = materialize(level.groupBy("key").agg(F.count("*").alias("of"), F.count_if(F.length("word") == F.col("base")).alias("queries"), F.max(F.col("b") - F.col("a")).alias("places")), "word-group-sizes")
        groups = groups.where("of > 1 and queries > 0")
        large = (F.col("of") > most) & (F.col("places") > 1)
        small = level.join(groups.where(~large).select("key"), "key")
        done = small if done is None else done.unionByName(small)
        if groups.where(large).isEmpty():
            break
        middle = F.expr("(a + b) div 2").cast("int")
        halves = F.array(F.struct("a", middle.alias("b")), F.struct(middle.alias("a"), "b"))
        split = level.join(groups.where(large).select("key"), "key").select("word", "n", "base", F.explode(halves).alias("h"))
        level = split.select("word", "n", "base", "h.a", "h.b")
    done = materialize(done, "word-lookups")
    tasks = max(1, -(-done.count() // task_words))
    placed = done.withColumns({"backward": F.col("a") == 0, "task": F.pmod("key", F.lit(tasks))})

    def look_up(key, table):
        base, backward = key[0].as_py(), key[1].as_py()
        columns = near_in_group(table.column("word").to_pylist(), *(x if isinstance(x, int) else x.to_numpy() for x in (table.column("n"), base, table.column("a"), table.column("b"))), backward)
        return pa.Table.from_arrays([pa.array(columns[0].tolist(), pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3].tolist(), pa.string())], names=["word", "n_near", "best_n", "best"])

    found = placed.groupBy("base", "backward", "task").applyInArrow(look_up, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("x"), F.col("best").alias("y"))).alias("m")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("m.x")).alias("best_n"), F.col("m.y").alias("best"))


def variants(words: DataFrame, ratio: int = 5, **how) -> DataFrame:
    """(word, n, n_near, form, form_n, root): a word's form is its most frequent near word if that is ratio times as frequent; root is the end of the
    chain of forms."""
    words = materialize(words.select("word", "n"), "words")
    near = near_words(words, **how)
    form = F.col("best_n") >= ratio * F.col("n")
    joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("best")).alias("form"), F.when(form, F.col("best_n")).alias("form_n"))
    joined = materialize(joined, "word-forms")
    chain = joined.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps; frequencies grow by ratio at every step, so rounds are few
        seen = Observation()
        onward = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = chain.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        chain = materialize(moved.observe(seen, F.count_if("moved").alias("n")), "word-roots").select("word", "root")
        if not seen.get["n"]:
            break
    return joined.join(chain, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11_spelling_variants(spark, sf_dir):
    """Every word of six code points and five occurrences with its near words and forms; one run of 199 loses a code point first."""
    return variants(word_counts(read(spark, sf_dir, "documents"), one_in=199)).select("word", "form", "root", "n", "n_near", "form_n")


OP11_SQL = """
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)
), r AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
  ) GROUP BY ALL
), b AS (
  SELECT doc_id, run, n, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(unicode(c) - 64 AS BIGINT)] END)) AS bytes FROM r
), h AS (
  SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b, crc
), w AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n, length(word) AS size FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM h
  ) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), d AS MATERIALIZED (
  SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, size + 1)) AS p FROM w)
), near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n AS other_n FROM d AS a JOIN d AS b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT w.word, d.word, d.n FROM w JOIN d ON d.rest = w.word
  UNION SELECT d.word, w.word, w.n FROM w JOIN d ON d.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS form_n, min(other) FILTER (other_n = most) AS form FROM (SELECT *, max(other_n) OVER (PARTITION BY word) AS most FROM near) GROUP BY word
), f AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n FROM w LEFT JOIN best USING (word)
), c(word, held) AS (
  SELECT word, word FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.held WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.held AS root, f.n, f.n_near, f.form_n FROM f JOIN c USING (word) JOIN f AS last ON last.word = c.held WHERE last.form IS NULL
"""
