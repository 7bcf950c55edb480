"""Plans: catalog layout, Bloom-filtered joins, heavy hitters, observed metrics, balanced partitions."""

import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clickloom.operators import bloom, session, skew
from clickloom.params import TaskParams
from clickloom.sources import catalog
from clickloom.sources.tables import fixtures

SF = "/root/testdata/sf0.001"
TASK = TaskParams.from_json('{"startDate": ["2024-01-05"], "endDate": ["2024-01-08"], "sex": ["male"]}', 1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def held(df):
    return Counter(map(tuple, df.select(sorted(df.columns)).collect()))


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bucketed_tables_need_no_exchange(spark, tmp_path, no_broadcast):
    t, name = fixtures(spark, SF), f"t{uuid.uuid4().hex}"
    actions = catalog.save_actions(t.actions, f"{name}_a", 4, f"{tmp_path}/a")
    try:
        assert held(actions) == held(t.actions)
        sessions = catalog.save_sessions(session.filtered_sessions(actions, t.users, TASK), f"{name}_s", 4, f"{tmp_path}/s")
        ranged = session.in_date_range(actions, "2024-01-05", "2024-01-08")
        detail = session.session_detail(ranged, sessions)
        plan = plan_of(detail)
        assert "Exchange" not in plan and "LeftSemi" in plan
        assert "PartitionFilters: [isnotnull(date" in plan and "2024-01-05" in plan  # only the days of the range are read
        assert {f.split("date=")[1][:10] for f in ranged.inputFiles()} == {f"2024-01-0{d}" for d in (5, 6, 7, 8)}
        assert ranged.select("date").distinct().count() <= 4
        aggregates = plan_of(session.session_aggregates(ranged))
        assert "Exchange" not in aggregates  # sessions lie whole in a bucket
        top = session.top_category_sessions(detail, session.top_categories(detail))
        want = session.session_detail(session.in_date_range(t.actions, "2024-01-05", "2024-01-08"), session.filtered_sessions(t.actions, t.users, TASK))
        assert held(detail) == held(want) and detail.count() > 0
        assert held(session.detail_of(detail, top)) == held(session.detail_of(want, session.top_category_sessions(want, session.top_categories(want))))
        catalog.save_actions(t.actions.where("user_id < 5"), f"{name}_a", 4, f"{tmp_path}/a")  # written again: replaced
        assert spark.table(f"{name}_a").count() == t.actions.where("user_id < 5").count()
    finally:
        catalog.drop(spark, f"{name}_a", f"{name}_s")


def exchanged_rows(df):
    """Rows that the plan's exchanges wrote, largest first."""
    df.write.format("noop").mode("overwrite").save()
    got = []

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            return walk(node.plan())
        if node.nodeName() == "Exchange":
            got.append(node.metrics().get("shuffleRecordsWritten").get().value())
        kids = node.children()
        for k in range(kids.size()):
            walk(kids.apply(k))

    df.collect()
    walk(df._jdf.queryExecution().executedPlan())
    return sorted(got, reverse=True)


def test_the_filter_cuts_what_is_exchanged(spark, no_broadcast):
    left = spark.range(200_000).select((F.col("id") % 50_000).alias("k"), F.col("id").alias("v"))
    right = spark.range(0, 50_000, 100).select(F.col("id").alias("k"))
    plain, filtered = left.join(right, "k", "left_semi"), bloom.bloom_semi_join(left, right, "k")
    assert exchanged_rows(plain)[0] == 200_000
    rows = exchanged_rows(filtered)[0]
    assert 2_000 <= rows <= 2_000 + 0.03 * 200_000  # one in a hundred belongs, one in eighty of the rest passes
    assert held(filtered) == held(plain) and filtered.count() == 2_000


def test_filters_miss_no_key_and_merge(spark):
    keys = spark.createDataFrame([(f"k{k}",) for k in range(300)] + [(None,)], "k string")
    every = spark.createDataFrame([(f"k{k}",) for k in range(5000)] + [(None,)], "k string")
    halves = [bloom.bloom_filter(keys.where(F.crc32(F.col("k").cast("binary")) % 2 == h), "k", n=300) for h in (0, 1)]
    for f in (bloom.bloom_filter(keys, "k"), halves[0].merge(halves[1])):
        passed = {r.k for r in every.where(f.maybe(F.col("k"))).collect()}
        assert {f"k{k}" for k in range(300)} <= passed and None not in passed and len(passed) < 300 + 0.06 * 4700
    whole = bloom.bloom_filter(keys, "k", n=300)
    assert whole.words.first().words == halves[0].merge(halves[1]).words.first().words
    with pytest.raises(ValueError):
        whole.merge(bloom.bloom_filter(keys, "k", n=3000))
    assert bloom.bloom_filter(keys, "k", n=10**9) is None  # too large: the join is the plain one
    assert held(bloom.bloom_semi_join(every, keys, "k", n=10**9)) == held(bloom.bloom_semi_join(every, keys, "k"))
    assert bloom.bloom_semi_join(every, keys.where("false"), "k").count() == 0


@pytest.mark.parametrize("share", [0.3, 0.02, 0.001])
def test_heavy_hitters_are_found_and_exact(spark, share):
    """A third of the rows on one key, a long tail, ties at the share, nulls; over many partitions."""
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.concat(F.lit("m"), (F.col("id") % 7).cast("string"))).when(F.col("id") % 11 == 0, None).otherwise(F.concat(F.lit("t"), (F.col("id") * 7919 % 20_011).cast("string"))).alias("k"), "id").repartition(13)
    n = Counter(r.k for r in rows.where("k is not null").collect())
    want = {(k, c) for k, c in n.items() if c >= share * sum(n.values())}
    got = [(r.k, r.n) for r in skew.heavy_hitters(rows, "k", share).collect()]
    assert set(got) == want and got == sorted(got, key=lambda x: (-x[1], x[0])) and want
    assert skew.heavy_hitters(rows.where("false"), "k", share).count() == 0


def test_heavy_keys_feed_the_split_join(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    hot = [r.k for r in skew.heavy_hitters(left, "k", 0.1).collect()]
    assert hot == [0] and held(skew.split_join(left, right, "k", hot, 7)) == held(left.join(right, "k"))
    with pytest.raises(ValueError):
        skew.heavy_hitters(left, "k", 0.0)


def test_observed_histogram(spark, tmp_path):
    t = fixtures(spark, SF)
    sessions = session.session_aggregates(t.actions)
    observed, counts = session.observed_histogram(sessions)
    observed.write.parquet(f"{tmp_path}/s")
    assert counts.get == session.session_histogram(sessions).first().asDict()
    spark.sparkContext.setJobGroup("histogram", "histogram")
    stat = session.observed_aggr_stat(spark, counts.get, 3).collect()
    spark.sparkContext.setJobGroup("other", "other")
    assert stat == session.session_aggr_stat(sessions, 3).collect()
    assert "Scan parquet" not in plan_of(session.observed_aggr_stat(spark, counts.get, 3))  # no pass over sessions
    nothing, none = session.observed_histogram(sessions.where("false"))
    nothing.write.parquet(f"{tmp_path}/none")
    empty = session.observed_aggr_stat(spark, none.get).first()
    assert empty.session_count == 0 and empty.step_length_60_ratio is None


def test_balanced_partitions(spark):
    """A skewed input comes out in parts of the advisory size; small ones are joined."""
    names = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        rows = spark.range(40_000).select(F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id") % 50).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))

        def sizes(df):
            return sorted(Counter(r.p for r in df.withColumn("p", F.spark_partition_id()).collect()).values())

        plain, even = sizes(rows.repartition(4, "k")), sizes(skew.balanced(rows, "k"))
        assert sum(plain) == sum(even) == 40_000
        assert max(plain) >= 36_000 and max(even) <= 10_000  # the hot key in one part, and over as many as there are tasks that wrote it
        assert len(sizes(skew.balanced(spark.range(100)))) == 1
        assert "REBALANCE" in plan_of(skew.balanced(rows, "k"))
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
