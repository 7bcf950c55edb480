"""The pipeline against a brute-force version of its stages."""

import os

import pytest

from clickloom.llm import mixing, quality
from clickloom.llm.common import materialize

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the generated tables are not here")


def test_stages(spark):
    import corpus_pipeline as p
    from test_llm_operators import brute_hits, brute_schedule, shingles

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = docs
    for k, (name, stage) in enumerate(p.STAGES):
        after = materialize(stage(spark, before, SF), f"test-stage-{k}")
        was, now = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in after.collect()}
        assert set(now) <= set(was) and all(now[d].text == was[d].text for d in now), name
        if k < 4:
            assert after.columns == columns
        if k == 0:
            kept = {r.doc_id for r in quality.judge(before, quality.train(before)).where("kept").collect()}
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            assert set(now) == kept
            assert sum((d in now) == (labels[d] == 1) for d in labels if d in was) >= 0.95 * len(labels)
        elif k == 1:
            ids = sorted(was)
            sets = {d: shingles(was[d].text, 5) for d in ids}
            parent = {d: d for d in ids}

            def find(x, parent=parent):
                while parent[x] != x:
                    x = parent[x]
                return x

            for i, a in enumerate(ids):
                for b in ids[:i]:
                    if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        x, y = sorted((find(a), find(b)))
                        parent[y] = x
            assert set(now) == {find(d) for d in ids}
        elif k == 2:
            assert set(now) == {d for d in was if not brute_hits(was[d].text, items)[4]}
        elif k == 3:
            held, block = {}, {r.doc_id: (r.source, r.block) for r in mixing.mix(before, fill=False, block_bytes=4096).collect()}
            for r in was.values():
                held[r.source] = held.get(r.source, 0) + max(len((r.text or "").encode()), 1)
            blocks = {s: -(-b // 4096) for s, b in held.items()}
            slots = brute_schedule(blocks, {s: b**0.7 for s, b in held.items()})
            end = min(slots[s, n] for s, n in blocks.items() if 10 * len(held) * held[s] >= sum(held.values())) + 1
            assert set(now) == {d for d, b in block.items() if slots[b] < end}
            assert 0.5 * len(was) < len(now) < len(was)  # over-weight sources lose documents
        else:
            assert set(now) == set(was)
            by = {}
            for r in now.values():
                by.setdefault(r.shard, []).append(r.slot)
            assert all(sorted(s) == list(range(len(s))) for s in by.values())
        before = after


def test_run_and_odd_rows(spark, tmp_path):
    import corpus_pipeline as p

    final = p.run(spark, SF)
    assert {"shard", "slot"} <= set(final.columns) and final.count() > 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "Some words here.", "en", None, 3), (1, "", "en", "src0", 0)], docs.schema)
    for rows in (docs.unionByName(odd).unionByName(docs.limit(5)), docs.where("false")):
        here = rows
        for k, (_, stage) in enumerate(p.STAGES):
            here = materialize(stage(spark, here, SF), f"odd-{k}")
        ids = [r.doc_id for r in here.collect() if r.doc_id is not None]
        assert len(ids) == len(set(ids))
