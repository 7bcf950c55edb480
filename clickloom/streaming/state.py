"""Keyed state of the ad-click stream: the blacklist by users, and the click trend by arrival.

Both are stateful processors of Structured Streaming; their state lies in the state store, partitioned by key and checkpointed with the batch, so no
batch reads a table to know who is listed or what has been counted. The state store must be RocksDB's (``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

DAY_MS = 86_400_000
BUCKETS = 1024
MOST = 100_000  # combined clicks that a task holds before it sends them on
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
SHUFFLE = "spark.sql.shuffle.partitions"
COMBINED = "user_id long, day long, minute long, province string, city string, ad_id long, n long"
JUDGED = "user_id long, minute long, province string, city string, ad_id long, n long, allowed boolean, listed boolean"
ARRIVED = "minute long, ad_id long, window_end long, click_count long"
_Arrived = Row(*(c.split()[0] for c in ARRIVED.split(", ")))  # rows with names


@contextmanager
def use_rocksdb(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, as keyed state asks for, in ``partitions`` parts; the session's own settings come back."""
    inside = {PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"} | ({} if partitions is None else {SHUFFLE: str(partitions)})
    before = {k: spark.conf.get(k, None) for k in inside}
    try:
        for k, v in inside.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def parts(spark: SparkSession) -> int:
    """Parts of the state if none are given: two a core (16 at least), and no more than the session's shuffle partitions.

    A part costs a state store to open, write and upload and a Python worker in every batch, however few clicks it has, and each job on the batch's
    results a task more.
    """
    return min(int(spark.conf.get(SHUFFLE)), max(16, 2 * spark.sparkContext.defaultParallelism))


def combined(clicks: DataFrame, most: int = MOST) -> DataFrame:
    """Clicks of parse_log counted by user, day and event minute (days and milliseconds since 1970), place and ad within each task.

    It needs no exchange and no state, and bounds what one busy user sends to the one task that holds that user's state. A task with more than
    ``most`` different ones sends what it holds and begins anew.
    """
    keys = ["user_id", "day", "minute", "province", "city", "ad_id"]

    def count(batches):
        import pyarrow as pa

        def add_up(tables):
            return pa.concat_tables(tables).group_by(keys).aggregate([("n", "sum")]).rename_columns([*keys, "n"])

        held, size = [], 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size >= most:
                held = [add_up(held)]
                size = held[0].num_rows
                if 2 * size >= most:  # little is alike
                    yield from held[0].combine_chunks().to_batches()
                    held, size = [], 0
        if size:
            yield from add_up(held).combine_chunks().to_batches()

    minute, day = F.unix_millis(F.date_trunc("minute", "ts")), F.unix_date(F.to_date("ts")).cast("long")
    rows = clicks.select("user_id", day.alias("day"), minute.alias("minute"), "province", "city", "ad_id", F.lit(1).cast("long").alias("n"))
    return rows.mapInArrow(count, COMBINED)


class Blacklist(StatefulProcessor):
    """Keyed by bucket of users: which of them are listed, and the clicks of the others by user, day and ad.

    A batch's clicks are judged by the list as it stood before the batch. A user who then has ``threshold`` clicks on one ad in a day is listed from
    the next batch on, for good, and the counts go. The counts of a day also go when the stream's event time is ``keep_ms`` past its end; a click
    that comes even later counts from 0.

    A call to the state store costs far more than a row, so a bucket's users are read and written together, as columns: two calls a bucket and batch
    instead of several a click. What a batch reads and writes is the state of the buckets that it touches.
    """

    KEYS = ["user_id", "day", "ad_id"]

    def __init__(self, threshold: int, keep_ms: int):
        self.threshold, self.keep_ms = threshold, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.users = handle.getValueState("users", "listed binary, counts binary")

    def _held(self):
        """The listed users, and the counts as a frame of user, day, ad and n."""
        import numpy as np
        import pandas as pd

        listed, counts = self.users.get() or (b"", b"")
        columns = np.frombuffer(bytes(counts), "<i8").reshape(4, -1)
        return np.frombuffer(bytes(listed), "<i8"), pd.DataFrame(dict(zip([*self.KEYS, "n"], columns, strict=True)))

    def _hold(self, listed, counts) -> None:
        import numpy as np

        self.users.update((listed.astype("<i8").tobytes(), np.concatenate([counts[c].to_numpy("<i8") for c in [*self.KEYS, "n"]]).tobytes()))

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np
        import pandas as pd

        listed, before = self._held()
        counts = [before]
        for part in rows:
            allowed = ~part["user_id"].isin(listed)
            counts.append(part.loc[allowed, [*self.KEYS, "n"]])
            yield part[["user_id", "minute", "province", "city", "ad_id", "n"]].assign(allowed=allowed, listed=False)
        after = pd.concat(counts).astype("int64").groupby(self.KEYS, as_index=False)["n"].sum()
        touched = pd.concat(counts[1:])["user_id"].unique()
        fresh = np.intersect1d(after.loc[after["n"] >= self.threshold, "user_id"], touched).astype("int64")
        after = after[~after["user_id"].isin(fresh)]
        self._hold(np.concatenate([listed, fresh]), after)
        if len(after) and not (len(before) and before["day"].min() <= after["day"].min()):
            self._wake(after)
        if len(fresh):
            none = dict.fromkeys(("minute", "province", "city", "ad_id"))
            yield pd.DataFrame({"user_id": fresh}).assign(**none, n=0, allowed=True, listed=True)

    def _end(self, day):
        return (day + 1) * DAY_MS + self.keep_ms

    def _wake(self, counts) -> None:
        """One timer a bucket, for its earliest day; the days after it follow from there."""
        self.handle.registerTimer(self._end(int(counts["day"].min())))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        listed, counts = self._held()
        left = counts[self._end(counts["day"]) > timerValues.getCurrentWatermarkInMs()]
        self._hold(listed, left)
        if len(left):
            self._wake(left)
        yield from ()

    def close(self) -> None:
        pass


def judged(clicks: DataFrame, threshold: int, keep_ms: int = 3 * DAY_MS, buckets: int = BUCKETS) -> DataFrame:
    """Combined clicks with ``allowed`` (their user was not listed before this batch), and a row with ``listed`` for each user who comes on the list.

    The watermark only drives the expiry of counts; no click is dropped for being late. ``buckets`` stays as it is for the life of a checkpoint.
    """
    bucket = F.pmod(F.xxhash64("user_id"), F.lit(buckets))
    keyed = combined(clicks.withWatermark("ts", "0 seconds")).withColumn("bucket", bucket).groupBy("bucket")
    found = keyed.transformWithStateInPandas(Blacklist(threshold, keep_ms), JUDGED, "Update", "EventTime").withColumn("minute", F.timestamp_millis("minute"))
    return found.withColumn("date", F.date_format("minute", "yyyy-MM-dd"))


class ArrivalTrend(StatefulProcessor):
    """Keyed by event minute and ad: clicks that arrived within the window, in panes of one slide.

    The window counts by arrival, whatever the events' own time: a late event counts in its own minute for as long as any other. A pane's count is
    added as it fills and subtracted once, by a timer, when the window has moved past it; each change gives one row with the end of the window it
    belongs to. A key without panes has no state.
    """

    def __init__(self, window_ms: int, slide_ms: int):
        self.window, self.slide = window_ms, slide_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.panes = handle.getMapState("panes", "start long", "n long")
        self.total = handle.getValueState("total", "n long")

    def _row(self, key, end: int, n: int) -> Row:
        return _Arrived(key[0], key[1], end, n)

    def _drop(self, total: int, start: int) -> int:
        held = self.panes.getValue((start,))
        if held:
            total -= held[0]
            self.panes.removeKey((start,))
        return total

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentProcessingTimeInMs()
        pane, n = now // self.slide * self.slide, sum(r.n for r in rows)
        total = self.total.get()[0] if self.total.exists() else 0
        if total:
            for start in [k[0] for k in self.panes.keys()]:
                if start < pane + self.slide - self.window:  # its timer is due in this batch
                    total = self._drop(total, start)
        held = self.panes.getValue((pane,))
        self.panes.updateValue((pane,), ((held[0] if held else 0) + n,))
        if not held:
            self.handle.registerTimer(pane + self.window + self.slide)
        self.total.update((total + n,))
        yield self._row(key, pane + self.slide, total + n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        end = expiredTimerInfo.getExpiryTimeInMs()
        if not self.total.exists():
            return
        before = self.total.get()[0]
        total = self._drop(before, end - self.window - self.slide)
        if total == before:
            return  # gone already
        if total:
            self.total.update((total,))
        else:
            self.total.clear()
        yield self._row(key, end, total)

    def close(self) -> None:
        pass


def arrival_trend(clicks: DataFrame, window: str = "60 minutes", slide: str = "10 seconds") -> DataFrame:
    """Clicks that arrived within the window, by event minute and ad, as changes: (minute, ad_id, window_end, click_count), also down to 0."""
    keyed = combined(clicks).groupBy("minute", "ad_id")
    found = keyed.transformWithState(ArrivalTrend(millis(clicks.sparkSession, window), millis(clicks.sparkSession, slide)), ARRIVED, "Update", "ProcessingTime")
    return found.withColumns({c: F.timestamp_millis(c) for c in ("minute", "window_end")})


def millis(spark: SparkSession, duration: str) -> int:
    """Milliseconds of a text such as '10 seconds'."""
    return spark.range(1).select(F.unix_millis(F.expr(f"timestamp_seconds(0) + interval {duration}"))).first()[0]
