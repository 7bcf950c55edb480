"""Ad-click kernels, on batches; the stream applies the same ones to each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parse_log(lines: DataFrame) -> DataFrame:
    """ts, province, city, user_id, ad_id, date from lines 'epochMillis province city userid adid'; lines of another form go."""
    part = F.split("value", " ")
    parsed = lines.where(F.col("value").isNotNull()).select(
        F.get(part, F.lit(0)).try_cast("long").alias("millis"),
        F.get(part, F.lit(1)).alias("province"),
        F.get(part, F.lit(2)).alias("city"),
        F.get(part, F.lit(3)).try_cast("long").alias("user_id"),
        F.get(part, F.lit(4)).try_cast("long").alias("ad_id"),
        F.size(part).alias("parts"),
    )
    sound = parsed.where("parts >= 5 and millis is not null and user_id is not null and ad_id is not null")
    ts = F.timestamp_millis("millis")
    return sound.select(ts.alias("ts"), "province", "city", "user_id", "ad_id", F.date_format(ts, "yyyy-MM-dd").alias("date"))


def without_blacklisted(clicks: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Clicks of users that are not on the blacklist."""
    return clicks.join(blacklist.select("user_id"), "user_id", "left_anti")


def user_click_counts(clicks: DataFrame) -> DataFrame:
    """Clicks by date, user and ad."""
    return clicks.groupBy("date", "user_id", "ad_id").agg(F.count("*").alias("click_count"))


def blacklisted_users(totals: DataFrame, threshold: int = 100) -> DataFrame:
    """Distinct users that clicked one ad at least threshold times in a day."""
    return totals.where(F.col("click_count") >= threshold).select("user_id").distinct()


def click_stat(clicks: DataFrame) -> DataFrame:
    """Clicks by date, province, city and ad."""
    return clicks.groupBy("date", "province", "city", "ad_id").agg(F.count("*").alias("click_count"))


def province_counts(stat: DataFrame) -> DataFrame:
    """The same without the city."""
    return stat.groupBy("date", "province", "ad_id").agg(F.sum("click_count").alias("click_count"))


def province_top(stat: DataFrame, n: int = 3) -> DataFrame:
    """The n most clicked ads of each date and province; smaller ad ids first among equals."""
    rank = F.row_number().over(W.partitionBy("date", "province").orderBy(F.desc("click_count"), "ad_id"))
    return province_counts(stat).withColumn("__rank", rank).where(F.col("__rank") <= n).select("date", "province", "ad_id", "click_count")


def click_trend(clicks: DataFrame) -> DataFrame:
    """Clicks by event minute and ad: date, hour, minute, ad_id, click_count. Clicks of blacklisted users count unless they
    were filtered before."""
    minute = F.date_trunc("minute", "ts")
    counted = clicks.groupBy(minute.alias("at"), "ad_id").agg(F.count("*").alias("click_count"))
    return counted.select(F.date_format("at", "yyyy-MM-dd").alias("date"), F.date_format("at", "HH").alias("hour"), F.date_format("at", "mm").alias("minute"), "ad_id", "click_count")
