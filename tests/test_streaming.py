import os
import random
import time
from collections import Counter, defaultdict
from pathlib import Path
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from clickloom.operators import ads, trend
from clickloom.params import Settings
from clickloom.sources.database import Database
from clickloom.sources.sinks import EpochStore, append
from clickloom.sources.snapshots import SnapshotStore
from clickloom.sources.tables import file_lines, generated_lines
from clickloom.streaming import state
from clickloom.streaming.ads_stream import AdStream, cumulative_counts, minute_trend, sliding_trend

BATCHES = [
    ["1704067200000 p1 c1 1 7"] * 2 + ["1704067200000 p1 c1 2 8"],
    ["1704067260000 p1 c1 1 7", "1704067260000 p1 c2 2 8", "nonsense"],
    ["1704067320000 p1 c1 1 7", "1704067320000 p2 c3 3 9"],
    ["1704153600000 p1 c1 1 7", "1704153600000 p1 c1 2 8", "1704067380000 p2 c3 3 9"],
    ["1704153660000 p1 c1 2 8", "1704153660000 p1 c1 2 8", "1704153660000 p1 c1 4 8"],
    ["1704153720000 p1 c1 2 8", "1704153720000 p2 c3 3 9"],
]
STORES = ("user_click_totals", "blacklisted", "stat_totals", "province_top", "trend_totals")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def replayed(batches, threshold):
    """What the stores hold in the end, by a plain loop."""
    listed, clicks, stat, minutes = set(), Counter(), Counter(), Counter()
    for lines in batches:
        allowed = []
        for line in lines:
            if len(parts := line.split(" ")) == 5:
                ms, province, city, user, ad = int(parts[0]), parts[1], parts[2], int(parts[3]), int(parts[4])
                t = time.gmtime(ms // 1000)
                date = time.strftime("%Y-%m-%d", t)
                minutes[date, time.strftime("%H", t), time.strftime("%M", t), ad] += 1
                if user not in listed:
                    allowed.append((date, province, city, user, ad))
        for date, province, city, user, ad in allowed:
            clicks[date, user, ad] += 1
            stat[date, province, city, ad] += 1
        listed |= {k[1] for k, n in clicks.items() if n >= threshold}
    by_province = defaultdict(Counter)
    for (date, province, _, ad), n in stat.items():
        by_province[date, province][ad] += n
    top = [(*k, ad, n) for k, c in by_province.items() for ad, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:3]]
    flat = [sorted((*k, n) for k, n in c.items()) for c in (clicks, stat, minutes)]
    return {"user_click_totals": flat[0], "blacklisted": sorted((u,) for u in listed), "stat_totals": flat[1], "province_top": sorted(top), "trend_totals": flat[2]}


def feed(folder, batches, first=0):
    """One file a batch, in order."""
    folder.mkdir(exist_ok=True)
    for k, lines in enumerate(batches, first):
        path = folder / f"{k}.txt"
        path.write_text("\n".join(lines) + "\n")
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))


def run(spark, stream, tmp_path):
    stream.start(file_lines(spark, str(tmp_path / "in"), 1), f"{tmp_path}/checkpoint", once=True).awaitTermination()


def check(stream, batches, threshold=3):
    want = replayed(batches, threshold)
    for name in STORES:
        assert rows(getattr(stream, name)()) == want[name], name


def test_batches_restart_and_replay(spark, tmp_path):
    """Six batches, with a restart after two and a batch that fails when half of it is written, equal the plain replay; so does the database."""
    db = Database(spark, f"jdbc:derby:memory:stream{time.time_ns()};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    stream = AdStream(spark, f"{tmp_path}/out", Settings(blacklist_threshold=3), database=db, fanout=2)
    feed(tmp_path / "in", BATCHES[:2])
    run(spark, stream, tmp_path)
    check(stream, BATCHES[:2])
    feed(tmp_path / "in", BATCHES[2:], 2)

    class Broken(AdStream):
        def _publish(self, rows, epoch, days):
            if epoch == 3:
                raise RuntimeError("the database is gone")
            super()._publish(rows, epoch, days)

    with pytest.raises(Exception):
        run(spark, Broken(spark, stream.folder, stream.settings, database=db, fanout=2), tmp_path)
    assert rows(stream.blacklisted()) == [(1,)]
    run(spark, stream, tmp_path)  # batch 3 is run again: its state, stores and rows in the database are written once
    check(stream, BATCHES)
    run(spark, stream, tmp_path)  # nothing new
    check(stream, BATCHES)
    want = replayed(BATCHES, 3)
    for table, name in (("ad_user_click_count", "user_click_totals"), ("ad_blacklist", "blacklisted"), ("ad_stat", "stat_totals"), ("ad_province_top3", "province_top"), ("ad_click_trend", "trend_totals")):
        assert sorted(map(tuple, db.read(table).collect())) == want[name], table


def test_no_store_is_read_for_the_blacklist(spark, tmp_path):
    """The list goes on from the state alone, whatever became of the table."""
    feed(tmp_path / "in", BATCHES[:3])
    stream = AdStream(spark, f"{tmp_path}/out", Settings(blacklist_threshold=3))
    run(spark, stream, tmp_path)
    feed(tmp_path / "in", BATCHES[3:], 3)
    moved = AdStream(spark, f"{tmp_path}/elsewhere", Settings(blacklist_threshold=3))
    run(spark, moved, tmp_path)
    assert rows(moved.blacklisted()) == [(2,)]  # user 1 came on the list before
    assert 1 not in {r[1] for r in rows(moved.user_click_totals())}


def test_counts_of_past_days_expire(spark, tmp_path):
    day = 86_400_000
    first = 1704067200000
    batches = [[f"{first} p c 1 7"] * 2 + [f"{first + 5 * day} p c 2 7"], [f"{first} p c 1 7"], [f"{first} p c 1 7"] * 2]
    feed(tmp_path / "in", batches)
    stream = AdStream(spark, f"{tmp_path}/out", Settings(blacklist_threshold=4), keep_ms=day)
    run(spark, stream, tmp_path)
    assert rows(stream.blacklisted()) == []  # five clicks in a day, but never four while its counts were kept
    assert rows(stream.user_click_totals()) == [("2024-01-01", 1, 7, 5), ("2024-01-06", 2, 7, 1)]
    kept = AdStream(spark, f"{tmp_path}/kept", Settings(blacklist_threshold=4), keep_ms=30 * day)
    kept.start(file_lines(spark, str(tmp_path / "in"), 1), f"{tmp_path}/kept-checkpoint", once=True).awaitTermination()
    assert rows(kept.blacklisted()) == [(1,)]


def test_the_trend_without_blacklisted_users(spark, tmp_path):
    feed(tmp_path / "in", BATCHES)
    stream = AdStream(spark, f"{tmp_path}/out", Settings(blacklist_threshold=3), filter_trend=True)
    run(spark, stream, tmp_path)
    total = sum(r[-1] for r in rows(stream.stat_totals()))
    assert sum(r[-1] for r in rows(stream.trend_totals())) == total < sum(r[-1] for r in replayed(BATCHES, 3)["trend_totals"])


def test_clicks_are_combined_before_the_exchange(spark):
    lines = spark.createDataFrame([(f"{1704067200000 + k} p1 c1 1 7",) for k in range(5000)], "value string").coalesce(1)
    found = state.combined(ads.parse_log(lines)).collect()
    assert len(found) == 1 and found[0].n == 5000  # a busy user is a row a task


def test_small_arrow_batches_are_combined_too(spark):
    """A session whose Arrow batches were bounded before still sends a busy user as a row a task; what a task holds is bounded."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "512")
    try:
        lines = spark.createDataFrame([(f"{1704067200000 + k} p1 c1 1 7",) for k in range(5000)], "value string").coalesce(1)
        assert [r.n for r in state.combined(ads.parse_log(lines)).collect()] == [5000]
        users = spark.createDataFrame([(f"1704067200000 p1 c1 {k % 1700} 7",) for k in range(5000)], "value string").coalesce(1)
        found = state.combined(ads.parse_log(users), most=1000).collect()
        assert sum(r.n for r in found) == 5000 and {r.user_id for r in found} == set(range(1700))
    finally:
        spark.conf.set(size, before)


class Counted:
    """The state of one bucket in memory, with the number of calls to it."""

    def __init__(self):
        self.held, self.timers, self.calls = None, set(), 0

    def getValueState(self, *_):
        def call(f):
            def counted(*a):
                self.calls += 1
                return f(*a)

            return counted

        return SimpleNamespace(exists=call(lambda: self.held is not None), get=call(lambda: self.held), update=call(lambda v: setattr(self, "held", v)))

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


def bucket_of(clicks, most=512):
    """Frames of (user, day, ad, n), as a bucket's processor gets them."""
    frame = pd.DataFrame(clicks, columns=["user_id", "day", "ad_id", "n"]).assign(minute=0, province="p", city="c")
    return iter([frame[k : k + most] for k in range(0, len(frame), most)])


def test_calls_to_the_state_do_not_grow_with_clicks():
    """They were several a click, which made the stream's time; a bucket of many users is now read and written as one."""
    calls = []
    for users in (10, 3000):
        handle, processor = Counted(), state.Blacklist(3, state.DAY_MS)
        processor.init(handle)
        for _ in range(2):
            clicks = [(u, 19723 + u % 30, 7, 1) for u in range(users)]
            assert sum(f["n"].sum() for f in processor.handleInputRows((0,), bucket_of(clicks), None)) == users
        calls.append(handle.calls)
    assert calls[0] == calls[1] <= 5


def test_a_bucket_judges_as_a_plain_loop_does():
    rng = random.Random(5)
    handle, processor = Counted(), state.Blacklist(3, state.DAY_MS)
    processor.init(handle)
    listed, counts = set(), Counter()
    for _ in range(12):
        clicks = [(rng.randrange(-40, 200), 19723 + rng.randrange(3), rng.randrange(3), rng.choice((1, 1, 1, 2))) for _ in range(60)]
        got = pd.concat(processor.handleInputRows((0,), bucket_of(clicks, 7), None))
        own = got[~got["listed"]]
        assert list(own["allowed"]) == [c[0] not in listed for c in clicks]
        for u, d, a, n in clicks:
            counts[u, d, a] += n * (u not in listed)
        now = {k[0] for k, n in counts.items() if n >= 3}
        assert sorted(got.loc[got["listed"], "user_id"]) == sorted(now - listed)
        listed |= now
    held, left = processor._held()
    assert set(held) == listed and {tuple(r) for r in left.to_numpy()} == {(*k, n) for k, n in counts.items() if k[0] not in listed}
    at = min(handle.timers)
    list(processor.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: at), SimpleNamespace(getExpiryTimeInMs=lambda: at)))
    assert set(processor._held()[1]["day"]) == {19724, 19725} and max(handle.timers) == at + state.DAY_MS and set(processor._held()[0]) == listed


def test_the_number_of_buckets_changes_no_result(spark, tmp_path):
    feed(tmp_path / "in", BATCHES)
    stream = AdStream(spark, f"{tmp_path}/out", Settings(blacklist_threshold=3), buckets=1)
    run(spark, stream, tmp_path)
    check(stream, BATCHES)


@pytest.fixture(scope="module")
def many_users(spark, tmp_path_factory):
    """A stream of two batches over 3,000 users, each of whom comes twice to thrice, with its batches."""
    folder = tmp_path_factory.mktemp("many")
    batches = [[f"{1704067200000 + 60_000 * (u % 90)} p{u % 3} c{u % 5} {u} {u % 4}" for u in range(3000) for _ in range(1 + (u % 7 == k))] for k in range(2)]
    feed(folder / "in", batches)
    stream = AdStream(spark, f"{folder}/out", Settings(blacklist_threshold=3))
    query = stream.start(file_lines(spark, str(folder / "in"), 1), f"{folder}/checkpoint", once=True)
    query.awaitTermination()
    return stream, replayed(batches, 3), query


@pytest.mark.parametrize("name", ["user_click_totals", "province_top", "stat_totals", "trend_totals"])
def test_the_state_has_no_row_for_every_user(many_users, name):
    """What each stream query takes from its store is whole, while the state that all of them wait for is a row a bucket."""
    stream, want, query = many_users
    assert rows(getattr(stream, name)()) == want[name]
    assert 0 < max(o.numRowsTotal for p in query.recentProgress for o in p.stateOperators) <= state.BUCKETS


@pytest.fixture(scope="module")
def default_session(spark, tmp_path_factory):
    """A stream started in a session of 200 shuffle partitions, Spark's default, with its query."""
    folder = tmp_path_factory.mktemp("default")
    feed(folder / "in", BATCHES[:3])
    before = spark.conf.get(state.SHUFFLE)
    spark.conf.set(state.SHUFFLE, "200")
    try:
        stream = AdStream(spark, f"{folder}/out", Settings(blacklist_threshold=3))
        query = stream.start(file_lines(spark, str(folder / "in"), 1), f"{folder}/checkpoint", once=True)
        query.awaitTermination()
        assert spark.conf.get(state.SHUFFLE) == "200"
        yield stream, replayed(BATCHES[:3], 3), query
    finally:
        spark.conf.set(state.SHUFFLE, before)


@pytest.mark.parametrize("name", ["user_click_totals", "province_top", "stat_totals", "trend_totals"])
def test_the_parts_of_the_state_follow_the_cores(default_session, name):
    """Every part costs a state store and a Python worker in each batch, which made most of the stream's time; 4 cores had 200 of them."""
    stream, want, query = default_session
    assert rows(getattr(stream, name)()) == want[name]
    assert {o.numShufflePartitions for p in query.recentProgress for o in p.stateOperators} == {16}


@pytest.mark.parametrize("name, store", [("province_top", "top"), ("stat_totals", "stat"), ("trend_totals", "trend")])
def test_a_batch_without_clicks_writes_no_store(default_session, name, store):
    """After the last clicks a batch follows that only moves the event time on; it wrote a segment and a manifest of every store."""
    stream, want, query = default_session
    assert [p.batchId for p in query.recentProgress if not p.numInputRows] == [3]
    assert [(s["first"], s["last"]) for s in getattr(stream, store).segments()] == [(0, 0), (1, 1), (2, 2)]
    assert rows(getattr(stream, name)()) == want[name]


def test_given_parts_of_the_state(spark, tmp_path):
    feed(tmp_path / "in", BATCHES[:3])
    stream = AdStream(spark, f"{tmp_path}/out", Settings(blacklist_threshold=3), partitions=3)
    query = stream.start(file_lines(spark, str(tmp_path / "in"), 1), f"{tmp_path}/checkpoint", once=True)
    query.awaitTermination()
    check(stream, BATCHES[:3])
    assert {o.numShufflePartitions for p in query.recentProgress for o in p.stateOperators} == {3}


def test_plain_streaming_aggregations(spark, tmp_path):
    source = Path(tmp_path, "in")
    source.mkdir()
    (source / "a.txt").write_text("\n".join(sum(BATCHES, [])) + "\n")
    batch = ads.parse_log(spark.read.text(str(source)))
    for name, make, want, mode in (
        ("counts", cumulative_counts, ads.click_stat(batch), "complete"),
        ("expiring", lambda c: cumulative_counts(c, "1 hour"), ads.click_stat(batch), "complete"),
        ("trend", minute_trend, ads.click_trend(batch), "complete"),
        ("sliding", lambda c: sliding_trend(c, "2 minutes", "1 minute"), None, "complete"),
    ):
        query = make(ads.parse_log(file_lines(spark, str(source)))).writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        query.awaitTermination()
        got = spark.table(name)
        if want is not None:
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
        else:
            assert got.selectExpr("sum(click_count)").first()[0] == 2 * batch.count()


def test_panes_equal_direct_windows(spark):
    ms = [1704067200000 + x for x in (0, 9_999, 10_000, 35_000, 35_000, 59_999, 60_000, 125_000, 3_599_000, 3_600_000, 7_205_000)]
    lines = spark.createDataFrame([(f"{m} p c {k} {k % 2}",) for k, m in enumerate(ms)], "value string")
    clicks = ads.parse_log(lines)
    for window, slide in (("60 minutes", "10 seconds"), ("2 minutes", "30 seconds"), ("10 seconds", "10 seconds")):
        intervals = trend.trend_intervals(trend.panes(clicks, slide), window, slide)
        got = trend.sliding_windows(intervals, window, slide)
        want = sliding_trend(clicks, window, slide)
        assert rows(got) == rows(want.select(got.columns))
        assert intervals.count() <= 2 * len(ms)  # rows a click do not grow with window / slide
    assert trend.trend_intervals(trend.panes(clicks.where("false"))).count() == 0


def test_the_streamed_event_time_trend(spark, tmp_path):
    """Panes come out once the watermark has passed them; a click behind it is dropped."""
    first = 1704067200000
    feed(tmp_path / "in", [[f"{first} p c 1 7"] * 2, [f"{first + 7_200_000} p c 1 7"], [f"{first + 7_200_000} p c 1 7"], [f"{first + 5_000} p c 1 7", f"{first + 10_800_000} p c 1 8"]])
    stream = AdStream(spark, f"{tmp_path}/out", Settings(trend_window="20 seconds"), fanout=2)
    stream.start_trend(file_lines(spark, str(tmp_path / "in"), 1), f"{tmp_path}/checkpoint", once=True, late="1 hour").awaitTermination()
    assert [r[2:] for r in rows(stream.panes.snapshot().selectExpr("pane", "minute", "ad_id", "click_count"))] == [(7, 2)]  # the last click moved the watermark to just before the next pane's end
    at = stream.trend_intervals().selectExpr("unix_millis(first_window)", "unix_millis(last_window)", "click_count").first()
    assert tuple(at) == (first - 10_000, first, 2)


class Fake:
    """State handles of one key, in memory."""

    def __init__(self):
        self.value, self.map, self.timers = None, {}, set()

    def getValueState(self, *_):
        held = self
        return SimpleNamespace(exists=lambda: held.value is not None, get=lambda: held.value, update=lambda v: setattr(held, "value", v), clear=lambda: setattr(held, "value", None))

    def getMapState(self, *_):
        m = self.map
        return SimpleNamespace(getValue=m.get, updateValue=m.__setitem__, removeKey=lambda k: m.pop(k, None), keys=lambda: iter(list(m)), clear=m.clear)

    def registerTimer(self, at):
        self.timers.add(at)


def test_the_trend_by_arrival_against_hand_values():
    """A minute's window of ten-second panes: clicks count from their arrival for a minute, however late they are."""
    fake, processor = Fake(), state.ArrivalTrend(60_000, 10_000)
    processor.init(fake)
    key = (1704067200000, 7)  # the event minute lies long before every arrival

    def arrive(now, n):
        clock = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: now)
        return [tuple(r)[2:] for r in processor.handleInputRows(key, iter([SimpleNamespace(n=n)]), clock)]

    def expire(at):
        fake.timers.remove(at)
        return [tuple(r)[2:] for r in processor.handleExpiredTimer(key, None, SimpleNamespace(getExpiryTimeInMs=lambda: at))]

    assert arrive(5_000, 2) == [(10_000, 2)]
    assert arrive(9_000, 1) == [(10_000, 3)]
    assert arrive(31_000, 4) == [(40_000, 7)]
    assert fake.timers == {70_000, 100_000}
    assert arrive(69_999, 1) == [(70_000, 5)]  # the window ends at 70 s and began at 10 s: the first three are out, before their timer
    assert expire(70_000) == []
    assert expire(100_000) == [(100_000, 1)]  # the four of 31 s are out
    assert expire(130_000) == [(130_000, 0)]
    assert fake.value is None and fake.map == {} and fake.timers == set()  # no state is left


def test_the_trend_by_arrival_as_a_stream(spark, tmp_path):
    """Late and early events count on arrival, and fall out of the window with time alone."""
    feed(tmp_path / "in", [["1704067200000 p c 1 7"] * 3 + ["1604067200000 p c 2 7", "nonsense"]])
    stream = AdStream(spark, f"{tmp_path}/out", Settings(trend_window="4 seconds", trend_slide="1 second", batch_interval="0 seconds"))
    query = stream.start_arrivals(file_lines(spark, str(tmp_path / "in"), 1), f"{tmp_path}/checkpoint")
    try:
        seen, until = [], time.time() + 90
        while time.time() < until:
            held = rows(stream.arrivals.snapshot().select("ad_id", "click_count", F.unix_millis("minute").alias("minute")))
            if held and held != (seen or [None])[-1]:
                seen.append(held)
            if held and all(h[1] == 0 for h in held):
                break
        assert seen[0] == [(7, 1, 1604067180000), (7, 3, 1704067200000)]
        assert seen[-1] == [(7, 0, 1604067180000), (7, 0, 1704067200000)]
        assert stream.arrival_counts().count() == 0
    finally:
        query.stop()


def test_snapshot_stores(spark, tmp_path):
    def frame(*r):
        return spark.createDataFrame(list(r), "k string, v long")

    store = SnapshotStore(spark, f"{tmp_path}/sum", "k string, v long", ("k",), "sum", fanout=2, keep=2)
    assert store.snapshot().count() == 0
    for e in range(9):
        for _ in range(2):  # a batch that is run again changes nothing
            store.write(frame(("a", 1), (f"k{e % 2}", 10)), e)
    assert rows(store.snapshot()) == [("a", 9), ("k0", 50), ("k1", 40)]
    assert rows(store.snapshot(7)) == [("a", 8), ("k0", 40), ("k1", 40)]  # a reader of an older manifest sees that batch
    assert rows(store.delta(8).drop("epoch")) == [("a", 1), ("k0", 10)]
    store.write(frame(("zz", 1)), 3)  # long whole
    assert ("zz", 1) not in rows(store.snapshot())
    last = SnapshotStore(spark, f"{tmp_path}/last", "k string, v long", ("k",), "last", fanout=2)
    groups = SnapshotStore(spark, f"{tmp_path}/groups", "k string, v long", ("k",), "groups", fanout=2)
    names = SnapshotStore(spark, f"{tmp_path}/names", "k string", ("k",), "last", fanout=2)
    for e, batch in enumerate(([("a", 1), ("b", 2)], [("a", 5)], [("c", 3)], [("b", 8)])):
        last.write(frame(*batch), e)
        groups.write(frame(*batch, *[(k, v + 100) for k, v in batch]), e)
        names.write(frame(*batch).select("k"), e)
    assert rows(last.snapshot()) == [("a", 5), ("b", 8), ("c", 3)]
    assert rows(groups.snapshot()) == [("a", 5), ("a", 105), ("b", 8), ("b", 108), ("c", 3), ("c", 103)]
    assert rows(names.snapshot()) == [("a",), ("b",), ("c",)]
    with pytest.raises(ValueError):
        SnapshotStore(spark, "x", "k string", ("k",), "other")


def test_files_of_a_snapshot_stay_bounded(spark, tmp_path, monkeypatch):
    """A thousand batches, with segments that are noted and not written: what a reader opens grows with the logarithm."""
    store = SnapshotStore(spark, f"{tmp_path}/store", "k string, v long", ("k",), "sum", fanout=8)
    state = {"segments": [], "rewritten": 0}

    def segment(self, rows, level, first, last):
        state["rewritten"] += last - first + 1
        return {"name": f"{first}-{last}", "level": level, "first": first, "last": last}

    monkeypatch.setattr(SnapshotStore, "_segment", segment)
    monkeypatch.setattr(SnapshotStore, "_read", lambda self, segments: None)
    monkeypatch.setattr(SnapshotStore, "_fold", lambda self, rows: None)
    for e in range(1000):
        state["segments"] = store._folded([*state["segments"], store._segment(None, 0, e, e)])
        covered = [x for s in state["segments"] for x in range(s["first"], s["last"] + 1)]
        assert covered == list(range(e + 1)) and len(covered) == len(set(covered))
        assert len(state["segments"]) <= 7 * 4
    assert state["rewritten"] <= 5 * 1000


def test_stores(spark, tmp_path):
    store = EpochStore(spark, f"{tmp_path}/store", "k string, v long")
    assert store.rows().count() == 0
    store.write(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long"), 0)
    store.write(spark.createDataFrame([("a", 5)], "k string, v long"), 1)
    assert rows(store.summed(["k"], "v"), "k") == [("a", 6), ("b", 2)]
    assert rows(store.summed(["k"], "v", before=1), "k") == [("a", 1), ("b", 2)]
    assert rows(store.latest(["k"], "v"), "k") == [("a", 5), ("b", 2)]
    assert rows(store.latest_groups(["k"]).select("k", "v"), "k") == [("a", 5), ("b", 2)]
    store.write(spark.createDataFrame([("a", 7)], "k string, v long"), 1)
    assert rows(store.compact(["k"], "v", f"{tmp_path}/compact").summed(["k"], "v"), "k") == [("a", 8), ("b", 2)]
    append(spark.range(3), f"{tmp_path}/append")
    append(spark.range(3), f"{tmp_path}/append")
    assert spark.read.parquet(f"{tmp_path}/append").count() == 6


def test_generated_lines_have_the_log_form(spark):
    assert generated_lines(spark).isStreaming
