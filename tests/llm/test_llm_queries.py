"""The registered queries on a small folder of tables, against their SQL or brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from clickloom.llm import jaccard, quality, toxicity
from clickloom.llm.queries import ORACLE_SQL, QUERIES
from clickloom.llm.textnum import Words, whitespace_table


def thue_morse(n):
    """Two different words of n letters on which sums of powers of any odd base agree modulo 2**64."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(41)
    prose = [" ".join(f"w{i}" for i in rng.integers(0, 900, 60 + 5 * k)) for k in range(30)]
    shared = " ".join(f"s{i}" for i in range(34))
    texts = [*prose, prose[3], prose[4] + " more", None, "", "PASSWORD = 'abc123xyz' and deadbeefdeadbeefdeadbeef00"]
    for n in (1024, 2048):
        for w in thue_morse(n):
            texts += [w, f"{shared} {w}", f"x y z {w}"]
    docs = [(k, t, "en", f"src{k % 3}" if k % 5 else None, len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    items = [(1, thue_morse(1024)[0]), (2, thue_morse(2048)[1]), (3, " ".join(prose[7].split()[10:30]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(k, k % 2, int(k % 4 == 0)) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    x = rng.normal(size=(40, 16)).astype(np.float32)
    x[20:] = x[:20] + rng.normal(scale=0.05, size=(20, 16)).astype(np.float32)
    spark.createDataFrame([(k, [float(c) for c in v], k % 4 or None) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder, texts


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_their_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables[0]}/{t}.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL[name]).fetchdf()
    got = QUERIES[name](spark, tables[0]).toPandas()[list(want.columns)]
    assert Counter(map(tuple, got.astype(str).to_numpy().tolist())) == Counter(map(tuple, want.astype(str).to_numpy().tolist()))


def test_op2_columns(spark, tables):
    got = QUERIES["op2_sharding"](spark, tables[0]).collect()
    slots = defaultdict(list)
    for r in got:
        raw = (tables[1][r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None) and 0 <= r.shard < 24
        slots[r.shard].append(r.slot)
    assert len(got) == len(tables[1]) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in got if tables[1][r.doc_id] == tables[1][3]}) == 1


def test_op4_columns(spark, tables):
    pattern = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    kinds = ("assign", "access", "hex", "learned")
    for r in QUERIES["op4_secrets"](spark, tables[0]).collect():
        t = tables[1][r.doc_id] or ""
        found = [[m.span() for m in pattern.finditer(t) if len(m[2]) >= 6], [m.span() for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20], [m.span() for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]]
        assert [r.n_assign, r.n_access, r.n_hex] == [len(x) for x in found]
        base = [f"{kinds[k]}:{s}:{e}" for s, k, e in sorted((s, k, e) for k, x in enumerate(found) for s, e in x)]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert [":".join(x) for x in spans if x[0] != "learned"] == base
        assert spans == sorted(spans, key=lambda x: (int(x[1]), kinds.index(x[0])))
        taken = [(int(s), int(e)) for k, s, e in spans if k != "learned"]
        for k, s, e in spans:
            if k == "learned":
                s, e = int(s), int(e)
                assert re.fullmatch("[A-Za-z0-9+/_.=-]{6,}", t[s:e]) and re.search("[A-Za-z]", t[s:e]) and not any(a < e and s < b for a, b in taken)
                assert not re.match("[A-Za-z0-9+/_.=-]", t[s - 1 : s] if s else "") and not re.match("[A-Za-z0-9+/_.=-]", t[e : e + 1])


def test_op5_op6_op7_give_every_document_a_row(spark, tables):
    for name in ("op5_mixing", "op6_quality", "op7_toxicity"):
        got = QUERIES[name](spark, tables[0]).collect()
        assert sorted(r.doc_id for r in got) == list(range(len(tables[1])))
        if name == "op5_mixing":
            assert all(r.chosen and r.release <= r.slot < r.deadline for r in got)
        if name == "op7_toxicity":
            assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in got)


def test_op6_op7_equal_their_models_text_by_text(spark, tables):
    """What the queries return is what the trained models say of each text alone."""
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet").select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{tables[0]}/labels.parquet"))
    for r in QUERIES["op7_toxicity"](spark, tables[0]).collect():
        assert abs(r.score - model.score(pa.array([tables[1][r.doc_id]], pa.string()))[0]) < 1e-9
        assert r.predicted == int(r.score >= 0.7)
    w, b, _ = quality.train(docs)
    for r in QUERIES["op6_quality"](spark, tables[0]).collect():
        text = tables[1][r.doc_id]
        alone = quality.score(Words(pa.array([text], pa.string()), whitespace_table()), w, b)[0] if (text or "").split() else 0.0
        assert abs(r.score - alone) < 1e-6, r.doc_id


def test_op8_equals_the_tokenizer(spark, tables):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t, start = Tokenizer.from_file(public.path("word_bpe_49k.json")), 0
    for r in sorted(QUERIES["op8_token_ids"](spark, tables[0]).collect(), key=lambda r: r.doc_id):
        want = np.array([*t.encode(tables[1][r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)


def test_rows_without_an_id_and_repeated_ids_stay(spark):
    """Copies among rows without a doc_id stay, whatever the other ids hash to; of equal rows one stays, of different texts with one id all that are no copies."""
    text = " ".join(f"w{k}" for k in range(80))
    other = " ".join(f"v{k}" for k in range(80))
    rows = [(16925938, text), (-5, text), (None, "a b c d e f"), (None, "a b c d e f"), (None, None), (7, other), (7, other + " z"), (7, "quite another text of some words"), (8, "x y z"), (8, "x y z"), (9, ""), (10, None)]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, __h string")
    got = Counter((r.doc_id, r.text) for r in jaccard.representatives(docs).collect())
    assert got[None, "a b c d e f"] == 2 and got[None, None] == 1 and got[-5, text] == 1 and (16925938, text) not in got
    assert got[7, other] + got[7, other + " z"] == 1 and got[7, rows[7][1]] == 1 and got[8, "x y z"] == 1 and got[9, ""] == got[10, None] == 1
