"""The ad-click stream.

``AdStream`` is one streaming query: the blacklist is state keyed by buckets of users (``state.Blacklist``), and each batch's judged clicks go as deltas to
snapshot stores, and from there to a database if there is one. ``start_trend`` and ``start_arrivals`` are the sliding trend as queries of their own, by event
time and by arrival. ``cumulative_counts`` and ``minute_trend`` are plain streaming aggregations, for streams that need no dynamic blacklist.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clickloom.operators import ads, trend
from clickloom.params import Settings
from clickloom.shipping import ship
from clickloom.sources.database import Database
from clickloom.sources.snapshots import SnapshotStore
from clickloom.streaming import state

CLICK_KEYS = ("date", "user_id", "ad_id")
STAT_KEYS = ("date", "province", "city", "ad_id")
TREND_KEYS = ("date", "hour", "minute", "ad_id")


@dataclass(frozen=True)
class AdStream:
    """The job and its stores under one folder.

    Everything a batch does is bound to its epoch: the state store goes back to the batch's own version when it is replayed, snapshot stores replace
    the batch's segment, and the database notes added epochs, so a batch that is run again changes nothing. A batch reads no store but the counts
    of the provinces that it touches. ``buckets`` is the number of keys of the blacklist's state, fixed for the life of a checkpoint: a batch
    reads and writes the users of the buckets that it touches. ``partitions`` is the number of parts that the state lies in, as fixed (a checkpoint
    keeps its own); unset, it follows the cores (``state.parts``).
    """

    spark: SparkSession
    folder: str
    settings: Settings = Settings()
    filter_trend: bool = False
    database: Database | None = None
    fanout: int = 8
    keep_ms: int = 3 * state.DAY_MS
    buckets: int = state.BUCKETS
    partitions: int | None = None

    def store(self, name: str, schema: str, keys: tuple[str, ...], kind: str = "sum") -> SnapshotStore:
        return SnapshotStore(self.spark, f"{self.folder}/{name}", schema, keys, kind, self.fanout)

    @property
    def user_clicks(self) -> SnapshotStore:
        return self.store("ad_user_click_count", "date string, user_id long, ad_id long, click_count long", CLICK_KEYS)

    @property
    def blacklist(self) -> SnapshotStore:
        return self.store("ad_blacklist", "user_id long", ("user_id",), "last")

    @property
    def stat(self) -> SnapshotStore:
        return self.store("ad_stat", "date string, province string, city string, ad_id long, click_count long", STAT_KEYS)

    @property
    def top(self) -> SnapshotStore:
        return self.store("ad_province_top3", "date string, province string, ad_id long, click_count long", ("date", "province"), "groups")

    @property
    def trend(self) -> SnapshotStore:
        return self.store("ad_click_trend", "date string, hour string, minute string, ad_id long, click_count long", TREND_KEYS)

    @property
    def panes(self) -> SnapshotStore:
        return self.store("ad_trend_panes", "pane timestamp, minute timestamp, ad_id long, click_count long", ("pane", "minute", "ad_id"))

    @property
    def arrivals(self) -> SnapshotStore:
        return self.store("ad_arrival_trend", "minute timestamp, ad_id long, window_end timestamp, click_count long", ("minute", "ad_id"), "last")

    def start(self, lines: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        """Start the stream; once: take what is there, batch by batch, and end."""
        found = state.judged(ads.parse_log(lines), self.settings.blacklist_threshold, self.keep_ms, self.buckets)
        return self._run(found, self.process, checkpoint, once)

    def process(self, rows: DataFrame, epoch: int) -> None:
        """Write one batch of judged clicks."""
        rows = rows.persist()  # else every store would run the batch's state again
        try:
            days = rows.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()  # runs the batch's state, before anything else reads it
            if days.a is None:
                return  # a batch that only moves the event time on: every result stays as it is
            clicks = rows.where("not listed")
            allowed = clicks.where("allowed")

            def ranked() -> None:
                self.stat.write(_counted(allowed, STAT_KEYS), epoch)
                touched = self._touched(allowed, self.stat, ("date", "province"), epoch, days)
                self.top.write(ads.province_top(touched, self.settings.top_ads), epoch)

            _together(
                ranked,
                lambda: self.user_clicks.write(_counted(allowed, CLICK_KEYS), epoch),
                lambda: self.blacklist.write(rows.where("listed").select("user_id"), epoch),
                lambda: self.trend.write(_counted(allowed if self.filter_trend else clicks, TREND_KEYS), epoch),
            )
            if self.database is not None:
                self._publish(rows, epoch, days)
        finally:
            rows.unpersist()

    def _touched(self, rows: DataFrame, store: SnapshotStore, keys: tuple[str, ...], epoch: int, days) -> DataFrame:
        """The store's rows after the batch, of the keys that the batch has."""
        held = store.rows(epoch).where(F.col("date").between(days.a, days.b))  # files of other days are skipped
        touched = held.join(_counted(rows, keys).select(*keys), list(keys), "left_semi")
        return touched.groupBy(*store.keys).agg(F.sum("click_count").alias("click_count"))

    def _publish(self, rows: DataFrame, epoch: int, days) -> None:
        """The batch's results as keyed writes: counts of users are added, once an epoch; totals and trend replace theirs; tops replace their group."""
        db, clicks = self.database, rows.where("not listed")
        allowed = clicks.where("allowed")
        db.add(_counted(allowed, CLICK_KEYS), "ad_user_click_count", list(CLICK_KEYS), epoch)
        db.upsert(rows.where("listed").select("user_id").distinct(), "ad_blacklist", ["user_id"])
        db.upsert(self._touched(allowed, self.stat, STAT_KEYS, epoch, days), "ad_stat", list(STAT_KEYS))
        db.upsert(self._touched(_counted(allowed if self.filter_trend else clicks, TREND_KEYS), self.trend, TREND_KEYS, epoch, days), "ad_click_trend", list(TREND_KEYS))
        groups = _counted(allowed, ("date", "province")).select("date", "province")
        db.replace_groups(self.top.snapshot(epoch).join(groups, ["date", "province"], "left_semi"), "ad_province_top3", ["date", "province"])

    def start_trend(self, lines: DataFrame, checkpoint: str, once: bool = False, late: str = "1 hour") -> StreamingQuery:
        """Start the sliding trend by event time: panes of settings.trend_slide, each written once the watermark has passed it; later clicks are dropped."""
        found = trend.panes(ads.parse_log(lines).withWatermark("ts", late), self.settings.trend_slide)
        return self._run(found, lambda rows, epoch: self.panes.write(rows, epoch), checkpoint, once, "append")

    def start_arrivals(self, lines: DataFrame, checkpoint: str) -> StreamingQuery:
        """Start the sliding trend by arrival: clicks of the last settings.trend_window, late ones in their own event minute. It goes on without
        new clicks, as counts fall with time, until it is stopped."""
        found = state.arrival_trend(ads.parse_log(lines), self.settings.trend_window, self.settings.trend_slide)

        def write(rows: DataFrame, epoch: int) -> None:
            # a key may change several times in a batch: what holds is the change of the last window
            last = F.max_by(F.struct("window_end", "click_count"), "window_end").alias("v")
            self.arrivals.write(rows.groupBy("minute", "ad_id").agg(last).select("minute", "ad_id", "v.*"), epoch)

        return self._run(found, write, checkpoint)

    def _run(self, rows: DataFrame, write, checkpoint: str, once: bool = False, mode: str = "update") -> StreamingQuery:
        ship(self.spark)
        writer = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
        writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=self.settings.batch_interval)
        with state.use_rocksdb(self.spark, self.partitions or state.parts(self.spark)):
            return writer.start()

    # what the stores hold

    def user_click_totals(self) -> DataFrame:
        return self.user_clicks.snapshot()

    def blacklisted(self) -> DataFrame:
        return self.blacklist.snapshot()

    def stat_totals(self) -> DataFrame:
        return self.stat.snapshot()

    def province_top(self) -> DataFrame:
        return self.top.snapshot()

    def trend_totals(self) -> DataFrame:
        return self.trend.snapshot()

    def trend_intervals(self) -> DataFrame:
        """The event-time trend so far, as runs of windows of equal count."""
        return trend.trend_intervals(self.panes.snapshot(), self.settings.trend_window, self.settings.trend_slide)

    def arrival_counts(self) -> DataFrame:
        """Clicks that arrived within the window, by event minute and ad, as of the last change."""
        return self.arrivals.snapshot().where("click_count > 0")


def _together(*writes) -> None:
    """Run small jobs side by side; all have ended when this returns or raises."""
    with ThreadPoolExecutor(len(writes)) as pool:
        for done in [pool.submit(inheritable_thread_target(w)) for w in writes]:
            done.result()


def _counted(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Judged or counted clicks added up by keys; hour and minute become texts of the event minute."""
    if "n" in rows.columns:
        rows = rows.select("*", F.col("n").alias("click_count"))
        if "hour" in keys:
            rows = rows.withColumns({"hour": F.date_format("minute", "HH"), "minute": F.date_format("minute", "mm")})
    return rows.groupBy(*keys).agg(F.sum("click_count").alias("click_count"))


def cumulative_counts(clicks: DataFrame, expire: str | None = None) -> DataFrame:
    """Clicks by day, province, city and ad as a streaming aggregation; use output mode update. With expire the state of a day goes
    once the watermark passes it; without, it is kept for good."""
    if expire is None:
        return ads.click_stat(clicks)
    day = F.window("ts", "1 day")
    counted = clicks.withWatermark("ts", expire).groupBy(day.alias("day"), "province", "city", "ad_id").agg(F.count("*").alias("click_count"))
    return counted.select(F.date_format("day.start", "yyyy-MM-dd").alias("date"), "province", "city", "ad_id", "click_count")


def minute_trend(clicks: DataFrame, late: str = "1 hour") -> DataFrame:
    """Clicks by event minute and ad with a watermark; later events than that are dropped. Use output mode update."""
    counted = clicks.withWatermark("ts", late).groupBy(F.window("ts", "1 minute").alias("w"), "ad_id").agg(F.count("*").alias("click_count"))
    return counted.select(F.date_format("w.start", "yyyy-MM-dd").alias("date"), F.date_format("w.start", "HH").alias("hour"), F.date_format("w.start", "mm").alias("minute"), "ad_id", "click_count")


def sliding_trend(clicks: DataFrame, window: str = "60 minutes", slide: str = "10 seconds", late: str = "1 hour") -> DataFrame:
    """Clicks by sliding window, event minute and ad, counted directly: every click in window / slide windows. ``trend`` gives the same from panes."""
    minute = F.date_trunc("minute", "ts")
    counted = clicks.withWatermark("ts", late).groupBy(F.window("ts", window, slide).alias("w"), minute.alias("minute"), "ad_id").agg(F.count("*").alias("click_count"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "minute", "ad_id", "click_count")
