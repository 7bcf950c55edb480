"""Spelling variants, vector codes and language identification against brute force, on odd rows, and as registered queries."""

import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from clickloom.llm import codes, language, spelling
from clickloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"


def equal_to_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    want = con.execute(ORACLE_SQL[name]).fetchall()
    columns = [d[0] for d in con.execute(ORACLE_SQL[name]).description]
    got = [tuple(r[c] for c in columns) for r in QUERIES[name](spark, folder).collect()]
    assert Counter(got) == Counter(want)
    return len(got)


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_vector_codes"])
def test_queries_equal_their_sql(spark, name):
    assert equal_to_sql(spark, SF, name) > 0


# spelling


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    if len(u) > len(v):
        u, v = v, u
    return len(v) == len(u) + 1 and any(v[:k] + v[k + 1 :] == u for k in range(len(v)))


def plain_variants(n, ratio=5):
    found, form = {}, {}
    for w in n:
        close = [v for v in n if v != w and near(w, v)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
        found[w] = (n[w], len(close), form[w], n[best] if form[w] else None)
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, *found[w], root))
    return out


def as_rows(df):
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


@pytest.mark.parametrize("most", [50_000, 4])
def test_variants_equal_all_pairs(spark, most):
    """Dense words of 1 to 9 letters, some beyond Latin, with groups of halves split down to single places in the second run."""
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abé𝒳"), size=k)) for k in rng.integers(1, 10, 500)} | {"a" * k for k in range(1, 12)} | {"hello", "helo", "helllo", "hxello"}
    n = {w: int(rng.integers(1, 6) ** 3) for w in words}
    got = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"), most=most, task_words=200)
    assert as_rows(got) == plain_variants(n)


def test_the_automaton_is_minimal_and_numbers_words(spark):
    words = sorted({x + y for x in ("re", "un", "in", "de") for y in ("load", "lock", "seat", "sealed")})
    width = max(map(len, words))
    found = spelling.Automaton(np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width))
    for k, w in enumerate(words):
        at = (np.array([0]), np.array([found.root]), np.array([0]))
        for c in w:
            at, _ = found.step(at, np.array([ord(c)]))
        assert found.final[at[1][0]] and at[2][0] == k
    beyond = {w[k:]: frozenset(v[len(w[:k]) :] for v in words if v.startswith(w[:k])) for w in words for k in range(len(w) + 1)}
    assert len(found.final) == len({frozenset(v[len(p) :] for v in words if v.startswith(p)) for p in {w[:k] for w in words for k in range(len(w) + 1)}}) and beyond


def plain_counts(rows, one_in):
    n = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{d}:{run}".encode())
            if one_in and d is not None and h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return n


def test_word_counts(spark):
    rng = np.random.default_rng(9)
    letters = list("abcXYZéÀÿ÷ŀ’ 1\n中")
    rows = [(k, "".join(rng.choice(letters, size=int(rng.integers(0, 400))))) for k in range(60)]
    rows += [(None, "abcabc " * 30), (7, None), (8, ""), (9, "é" * 70 + " " + "x" * 300), (9, "é" * 70 + " " + "x" * 300), (-3, "Abc ÀBC " * 40), (10, "word" * 300_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, word int")
    for one_in in (None, 3):
        got = spelling.word_counts(docs, 1, 1, one_in)
        assert {r.word: r.n for r in got.collect()} == {w: c for w, c in plain_counts(rows, one_in).items() if w}
    assert {r.word: r.n for r in spelling.word_counts(docs, 4, 9, 2).collect()} == {w: c for w, c in plain_counts(rows, 2).items() if len(w) >= 4 and c >= 9}
    assert spelling.variants(spelling.word_counts(docs.where("false"))).count() == 0


def test_long_words_are_compared_whole(spark):
    base = "".join(chr(97 + k * k % 26) for k in range(3000))
    n = {base: 50, base[:2900] + base[2901:]: 3, base[:10] + "ZZ" + base[12:]: 3, base + "q": 9}
    assert as_rows(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"))) == plain_variants(n)


# vector codes


def plain_codes(rows, parts, entries, rounds):
    kept = sorted((i, [int(np.floor(float(x) * 256)) for x in v], lab) for i, v, lab in rows if v and all(x is not None and np.isfinite(x) for x in v))
    width = len(kept[0][1]) // parts
    cut = [[v[k * width : (k + 1) * width] for k in range(parts)] for _, v, _ in kept]
    books = [[c[k] for c in cut[:entries]] for k in range(parts)]

    def nearest(book, p):
        return min((sum((a - b) ** 2 for a, b in zip(p, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for k in range(parts):
            at = [nearest(books[k], c[k])[1] for c in cut]
            for j in range(len(books[k])):
                own = [c[k] for c, a in zip(cut, at) if a == j]
                if own:
                    books[k][j] = [sum(x) // len(own) for x in zip(*own)]
    best = [[nearest(books[k], c[k]) for k in range(parts)] for c in cut]
    return sorted((i, tuple(j for _, j in b), sum(d for d, _ in b)) for (i, _, _), b in zip(kept, best)), books


def test_codes_equal_all_distances(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 12)) * 4) / 8  # on a grid: many ties
    rows = [(k, [float(c) for c in v], k % 3 if k % 7 else None) for k, v in enumerate(x)]
    rows += [(300, None, 1), (301, [float("nan")] * 12, 1), (302, [None] + [0.0] * 11, 1), (303, [float("inf")] + [0.0] * 11, 2), (304, [], 0), (305, rows[0][1], None)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, codes string")
    for parts, entries in ((4, 16), (3, 64), (12, 500)):
        want, books = plain_codes(rows, parts, entries, 2)
        got, found = codes.compress(frame, parts, entries)
        assert sorted((r.vec_id, tuple(r.codes), r.error) for r in got.collect()) == want
        assert [b.tolist() for b in found] == books


def test_the_annulus_holds_every_tie():
    entries = np.array([[3, 4], [5, 0], [-5, 0], [0, 5], [0, 0], [3, 4]])
    points = np.array([[0, 0], [4, 2], [3, 4], [10, 0], [2, 2], [-3, -4]])
    index, distance = codes.Book(entries).nearest(points)
    every = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert index.tolist() == every.argmin(1).tolist() and distance.tolist() == every.min(1).tolist()


def test_odd_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert codes.compress(spark.createDataFrame([], schema))[0].count() == 0
    assert codes.compress(spark.createDataFrame([(1, None, 1), (2, [1.0] * 5, 1)], schema), parts=4)[0].count() == 0  # four does not divide five
    rows = [(4, [1.0] * 8, 1), (None, [2.0] * 8, 1), (2, [0.5] * 8, 1), (2, [0.5] * 8, None), (1, [9.0] * 4, 1), (3, [1e9] + [0.0] * 7, 1)]
    got, books = codes.compress(spark.createDataFrame(rows[:4], schema), parts=4, entries=3)
    assert sorted((r.vec_id or 0, r.error) for r in got.collect()) == [(0, 0), (2, 0), (2, 0), (4, 0)] or len(books[0]) == 3
    got, _ = codes.compress(spark.createDataFrame(rows, schema), parts=4, entries=3)
    assert [r.vec_id for r in got.collect()] == [1]  # the first one's dimension holds


def test_labels_of_any_share(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(k, [float(c) for c in v], 5 if k % 3 else None) for k, v in enumerate(rng.normal(size=(90, 16)).astype(np.float32))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert equal_to_sql(spark, str(tmp_path), "op12_vector_codes") == 90


# languages


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    got = QUERIES["op13_language"](spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    assert len(got) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert len(out) > 200 and sum(r.lang_pred == r.lang for r in out) >= 0.98 * len(out)
    low = [r for r in got if r.lang_pred != r.lang]
    assert all(r.score < 0.95 for r in low)


def plain_subwords(word):
    padded = b"\x01" + word + b"\x01"
    return Counter(len(padded[i : i + k]) for k in language.LENGTHS for i in range(len(padded) - k + 1)), len(padded) > max(language.LENGTHS)


def test_subwords_and_averages():
    words = [b"a", b"abc", b"longer", "né".encode()]
    owner, bucket = language.subwords(pa.array(words, pa.large_binary()))
    for k, w in enumerate(words):
        sizes, whole = plain_subwords(w)
        assert (owner == k).sum() == sum(sizes.values()) + whole
    assert bucket.min() >= 0 and bucket.max() < language.BUCKETS
    rng = np.random.default_rng(1)
    model = language.Model(["x", "y"], rng.normal(size=(language.BUCKETS, 2)), np.array([0.1, -0.2]))
    texts = ["abc ABC né", "", None, "longer a a a 12 longer", "12 !?"]
    got = model.logits(pa.array(texts))
    for row, t in zip(got, texts):
        held = re.findall("[a-z\x80-\U0010ffff]+", (t or "").lower())
        own = [bucket[owner == words.index(w.encode())] for w in held]
        n = sum(map(len, own)) + language.BLANK
        want = model.bias + sum((model.table[b].sum(0) for b in own), np.zeros(2)) / n
        assert np.allclose(row, want)
    counts = language.counted(pa.array(texts))
    assert [int(n.sum()) for _, n in counts] == [sum(len(bucket[owner == words.index(w.encode())]) for w in re.findall("[a-z\x80-\U0010ffff]+", (t or "").lower())) for t in texts]


def test_one_step_equals_the_plain_gradient():
    rows, target = [(np.array([3, 9]), np.array([2, 1])), (np.array([9]), np.array([4]))], np.array([0, 1])
    table, bias = language.fit(rows, target, 2, size=4, epochs=1, rate=0.5, batch=2)
    w = np.random.default_rng(7).normal(scale=0.5, size=(4, 2))
    error = np.array([[-0.5, 0.5], [0.5, -0.5]]) / 2  # embeddings begin at zero
    x = np.zeros((2, language.BUCKETS))
    for r, (k, n) in enumerate(rows):
        x[r, k] = n / (n.sum() + language.BLANK)
    e = -0.5 * 2 * x.T @ (error @ w.T)
    assert np.allclose(table, e @ w) and np.allclose(bias, -0.5 * 2 * 0.01 * error.sum(0))


def test_calibration():
    z = np.array([[9.0, 0], [9, 0], [0, 9], [6, 0], [0, 5]])
    t, limit = language.calibrate(z, np.array([0, 0, 1, 1, 1]))
    assert t > 1  # one confident answer was wrong
    p = language.softmax(z / t).max(1)
    assert np.isclose(limit, p[0])  # below it stands the wrong one
    assert language.calibrate(np.empty((0, 2)), np.empty(0, int)) == (1.0, 0.0)


def test_odd_texts_and_labels(spark):
    rows = [(k, " ".join(["the", "and", "house"] * 9), "en") for k in range(40)] + [(k, " ".join(["der", "und", "haus"] * 9), "de") for k in range(40, 80)]
    rows += [(80, None, "en"), (81, "", "de"), (82, "12 34 !?", None), (None, "the house", "en"), (83, "the and " * 200_000, None), (84, "中文 中文", None), (85, "the house", "en"), (85, "the house", "en")]
    docs = spark.createDataFrame([(*r, "q", 1) for r in rows], f"{DOCS}, score string, __letter int")
    model = language.train(docs)
    assert model.languages == ["de", "en"]
    got = language.identify(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "__letter", "lang_pred", "score", "rejected"]
    held = got.collect()
    assert len(held) == len(rows)
    for r in held:
        if r.doc_id in (80, 81, 82):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        elif r.doc_id == 84:
            assert r.lang_pred in model.languages and r.score < 0.9
        else:
            assert r.lang_pred == (r.lang or "en")
    none = language.train(docs.where("lang is null"))
    assert {(r.lang_pred, r.score) for r in language.identify(docs, none).collect()} == {("und", 0.0)}
    assert language.identify(docs.where("false"), model).count() == 0


def test_the_held_out_teach_nothing(spark):
    out = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2]
    rows = [(k, "only these speak klingon", "tlh") for k in out] + [(k, "plain words here", "en") for k in range(400) if k not in out]
    assert language.train(spark.createDataFrame(rows, DOCS)).languages == ["en"]
