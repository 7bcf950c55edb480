"""The sliding click trend by event time, from panes.

Counting each click in every window it lies in costs window / slide rows a click. Here clicks are counted once, in the pane (one slide) they
lie in; a window's count is a running sum that adds each pane when the window reaches it and subtracts it when the window has passed it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def panes(clicks: DataFrame, slide: str = "10 seconds") -> DataFrame:
    """(pane, minute, ad_id, click_count): clicks by pane of one slide (its start), event minute and ad. On a stream with a watermark the pane column keeps it."""
    counted = clicks.groupBy(F.window("ts", slide).alias("w"), F.date_trunc("minute", "ts").alias("minute"), "ad_id").agg(F.count("*").alias("click_count"))
    return counted.select(F.col("w.start").alias("pane"), "minute", "ad_id", "click_count")


def _micros(duration: str):
    return F.unix_micros(F.expr(f"timestamp_seconds(0) + interval {duration}"))


def trend_intervals(panes: DataFrame, window: str = "60 minutes", slide: str = "10 seconds") -> DataFrame:
    """(minute, ad_id, first_window, last_window, click_count): runs of windows, by their start, over which the count stays the same and is not 0.

    Two changes a pane, however many windows it lies in; the running sums go over the changes of one event minute and ad, a few
    rows (an event minute touches as many panes as a minute has slides, and one more).
    """
    at, size, step = F.unix_micros("pane"), _micros(window), _micros(slide)
    change = F.array(F.struct((at - size + step).alias("at"), F.col("click_count").alias("d")), F.struct((at + step).alias("at"), (-F.col("click_count")).alias("d")))
    changes = panes.select("minute", "ad_id", F.explode(change).alias("c")).groupBy("minute", "ad_id", F.col("c.at").alias("at")).agg(F.sum("c.d").alias("d")).where("d <> 0")
    order = W.partitionBy("minute", "ad_id").orderBy("at")
    runs = changes.withColumns({"click_count": F.sum("d").over(order), "until": F.lead("at").over(order)}).where("click_count > 0")
    return runs.select("minute", "ad_id", F.timestamp_micros("at").alias("first_window"), F.timestamp_micros(F.col("until") - step).alias("last_window"), "click_count")


def sliding_windows(intervals: DataFrame, window: str = "60 minutes", slide: str = "10 seconds") -> DataFrame:
    """Every window of the intervals as a row: (window_start, window_end, minute, ad_id, click_count)."""
    starts = F.sequence(F.col("first_window"), F.col("last_window"), F.expr(f"interval {slide}"))
    rows = intervals.select("minute", "ad_id", "click_count", F.explode(starts).alias("window_start"))
    return rows.select("window_start", (F.col("window_start") + F.expr(f"interval {window}")).alias("window_end"), "minute", "ad_id", "click_count")
