"""Session analysis: aggregates, filters, histogram, sample, top categories and top sessions.

One lazily evaluated chain: actions -> sessions -> filtered sessions -> detail; each report is a function of those.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickloom.functions.columns import as_time, csv_items, joined_ids, group_concat_distinct, ratio, round_half_up
from clickloom.params import TaskParams

# Inclusive bins of the histogram; None is open-ended. A visit of 0 seconds is in no bin.
VISIT_BINS = {
    "visit_length_1s_3s": (1, 3),
    "visit_length_4s_6s": (4, 6),
    "visit_length_7s_9s": (7, 9),
    "visit_length_10s_30s": (10, 30),
    "visit_length_31s_60s": (31, 60),
    "visit_length_1m_3m": (61, 180),
    "visit_length_3m_10m": (181, 600),
    "visit_length_10m_30m": (601, 1800),
    "visit_length_30m": (1801, None),
}
STEP_BINS = {
    "step_length_1_3": (1, 3),
    "step_length_4_6": (4, 6),
    "step_length_7_9": (7, 9),
    "step_length_10_30": (10, 30),
    "step_length_31_60": (31, 60),
    "step_length_60": (61, None),
}
DETAIL_COLUMNS = (
    "user_id",
    "session_id",
    "page_id",
    "action_time",
    "search_keyword",
    "click_category_id",
    "click_product_id",
    "order_category_ids",
    "order_product_ids",
    "pay_category_ids",
    "pay_product_ids",
)


def in_date_range(actions: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Actions whose date lies in [start, end], both ends included; an end that is None is open."""
    if start is not None:
        actions = actions.where(F.col("date") >= start)
    if end is not None:
        actions = actions.where(F.col("date") <= end)
    return actions


def session_aggregates(actions: DataFrame) -> DataFrame:
    """One row per session: user_id, distinct keywords and clicked categories (sorted and joined), start_time, visit_length in whole
    seconds, step_length.

    Values are exact distinct sets, so category 1 counts beside 12, and the user is the smallest seen, not the first.
    """
    time = as_time(F.col("action_time"))
    return actions.groupBy("session_id").agg(
        F.min("user_id").alias("user_id"),
        group_concat_distinct(F.when(F.col("search_keyword") != "", F.col("search_keyword"))).alias("search_keywords"),
        joined_ids(F.col("click_category_id")).alias("click_category_ids"),
        (F.unix_timestamp(F.max(time)) - F.unix_timestamp(F.min(time))).alias("visit_length"),
        F.count("*").alias("step_length"),
        F.date_format(F.min(time), "yyyy-MM-dd HH:mm:ss").alias("start_time"),
    )


def with_users(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Sessions with age, professional, city and sex of their users; sessions of unknown users go."""
    return sessions.join(users.select("user_id", "age", "professional", "city", "sex"), "user_id")


def session_predicate(task: TaskParams) -> Column:
    """AND of the task's filters, for where(). A filter that is not set passes everything; one that is set rejects missing data
    (it is null there, which where() drops; so each part can be pushed to its table). An age range counts only with both ends."""
    parts: list[Column] = []
    if task.start_age is not None and task.end_age is not None:
        parts.append(F.col("age").between(task.start_age, task.end_age))
    if task.professionals:
        parts.append(F.col("professional").isin(*task.professionals))
    if task.cities:
        parts.append(F.col("city").isin(*task.cities))
    if task.sex is not None:
        parts.append(F.col("sex") == task.sex)
    if task.keywords:
        parts.append(F.arrays_overlap(csv_items(F.col("search_keywords")), F.array(*map(F.lit, task.keywords))))
    if task.category_ids:
        parts.append(F.arrays_overlap(csv_items(F.col("click_category_ids")), F.array(*(F.lit(str(c)) for c in task.category_ids))))
    every = F.lit(True)
    for p in parts:
        every = every & p
    return every


def filtered_sessions(actions: DataFrame, users: DataFrame, task: TaskParams) -> DataFrame:
    scanned = in_date_range(actions, task.start_date, task.end_date)
    return with_users(session_aggregates(scanned), users).where(session_predicate(task))


def session_detail(actions: DataFrame, sessions: DataFrame) -> DataFrame:
    """All actions of the sessions."""
    return actions.join(sessions.select("session_id"), "session_id", "left_semi")


def _count_in(c: str, low: int, high: int | None) -> Column:
    return F.count_if(F.col(c) >= low if high is None else F.col(c).between(low, high))


def _histogram() -> list[Column]:
    visit = [_count_in("visit_length", *b).alias(name) for name, b in VISIT_BINS.items()]
    step = [_count_in("step_length", *b).alias(name) for name, b in STEP_BINS.items()]
    return [F.count("*").alias("session_count"), *visit, *step]


def session_histogram(sessions: DataFrame) -> DataFrame:
    """One row: session_count and the sessions in each visit and step bin."""
    return sessions.agg(*_histogram())


def observed_histogram(sessions: DataFrame) -> tuple[DataFrame, Observation]:
    """The sessions, and their histogram as metrics of the pass that writes them: no pass of its own.

    ``get`` of the observation has the counts once the first action over the returned sessions has ended. Write them with nothing behind
    that exchanges rows: then the counts come from the tasks that write, each of which Spark counts once however often it was tried.
    """
    seen = Observation("session_histogram")
    return sessions.observe(seen, *_histogram()), seen


def _shares(counts: DataFrame, task_id: int) -> DataFrame:
    shares = [round_half_up(ratio(F.col(n), F.col("session_count"))).alias(f"{n}_ratio") for n in (*VISIT_BINS, *STEP_BINS)]
    return counts.select(F.lit(task_id).cast("long").alias("task_id"), "session_count", *shares)


def session_aggr_stat(sessions: DataFrame, task_id: int = 0) -> DataFrame:
    """The histogram as shares of all sessions to two decimals; null without sessions."""
    return _shares(session_histogram(sessions), task_id)


def observed_aggr_stat(spark: SparkSession, counts: dict[str, int], task_id: int = 0) -> DataFrame:
    """The same from an observed histogram."""
    names = ["session_count", *VISIT_BINS, *STEP_BINS]
    return _shares(spark.createDataFrame([tuple(counts[n] for n in names)], ", ".join(f"{n} long" for n in names)), task_id)


def sessions_per_hour(sessions: DataFrame) -> DataFrame:
    """date, hour, session_count by start time."""
    return sessions.groupBy(F.substring("start_time", 1, 10).alias("date"), F.substring("start_time", 12, 2).alias("hour")).agg(F.count("*").alias("session_count"))


def sample_quotas(sessions: DataFrame, total: int = 100) -> DataFrame:
    """How many sessions of each hour to draw: total / days for a day, its share of the day for an hour, both cut to whole numbers,
    and no more than the hour has. Without sessions there are no rows."""
    hours = sessions_per_hour(sessions)
    # one row per hour of the range, so one task may see them all to count the days
    by_day = hours.withColumn("day_count", F.sum("session_count").over(W.partitionBy("date")))
    by_day = by_day.withColumn("days", F.size(F.collect_set("date").over(W.partitionBy(F.lit(0)))))
    quota = F.expr(f"session_count * ({total} div days) div day_count")
    return by_day.select("date", "hour", "session_count", F.least(quota, F.col("session_count")).alias("quota"))


def sample_sessions(sessions: DataFrame, total: int = 100, seed: int = 9, task_id: int = 0) -> DataFrame:
    """A stratified sample: the quota of every hour, in the order of md5 of session id and seed, so that it can be repeated."""
    order = F.md5(F.concat_ws(":", "session_id", F.lit(str(seed))).cast("binary"))
    hour = sessions.withColumns({"date": F.substring("start_time", 1, 10), "hour": F.substring("start_time", 12, 2), "__order": order})
    rank = F.row_number().over(W.partitionBy("date", "hour").orderBy("__order", "session_id"))
    # no quota exceeds the total: the limit below cuts every hour before it is exchanged
    first = hour.withColumn("__rank", rank).where(F.col("__rank") <= total)
    drawn = first.join(F.broadcast(sample_quotas(sessions, total).select("date", "hour", "quota")), ["date", "hour"]).where(F.col("__rank") <= F.col("quota"))
    return drawn.select(F.lit(task_id).cast("long").alias("task_id"), "session_id", "start_time", "search_keywords", "click_category_ids")


def detail_of(actions: DataFrame, session_ids: DataFrame, task_id: int = 0) -> DataFrame:
    """Detail rows of the sessions, once each however often a session is listed; nulls stay null."""
    return session_detail(actions, session_ids).select(F.lit(task_id).cast("long").alias("task_id"), *DETAIL_COLUMNS)


def category_counts(detail: DataFrame) -> DataFrame:
    """category_id, click_count, order_count, pay_count of every category that occurs, in one pass over the actions."""
    ids = F.concat(
        F.when(F.col("click_category_id").isNotNull(), F.array(_hit(F.col("click_category_id"), 0))).otherwise(F.array().cast(_HITS)),
        F.coalesce(F.transform(csv_items(F.col("order_category_ids")), lambda x: _hit(x.try_cast("long"), 1)), F.array().cast(_HITS)),
        F.coalesce(F.transform(csv_items(F.col("pay_category_ids")), lambda x: _hit(x.try_cast("long"), 2)), F.array().cast(_HITS)),
    )
    hits = detail.select(F.explode(ids).alias("h")).select("h.*").where("category_id is not null")
    counts = [F.count_if(F.col("kind") == k).alias(name) for k, name in enumerate(("click_count", "order_count", "pay_count"))]
    return hits.groupBy("category_id").agg(*counts)


_HITS = "array<struct<category_id:bigint,kind:int>>"


def _hit(category: Column, kind: int) -> Column:
    return F.struct(category.alias("category_id"), F.lit(kind).alias("kind"))


def top_categories(detail: DataFrame, n: int = 10, task_id: int = 0) -> DataFrame:
    """The n categories with most clicks, then orders, then payments; smaller ids first among equals."""
    order = [F.desc("click_count"), F.desc("order_count"), F.desc("pay_count"), F.asc("category_id")]
    return category_counts(detail).orderBy(*order).limit(n).select(F.lit(task_id).cast("long").alias("task_id"), "category_id", "click_count", "order_count", "pay_count")


def top_category_sessions(detail: DataFrame, categories: DataFrame, n: int = 10, task_id: int = 0) -> DataFrame:
    """For each of the categories the n sessions with most clicks on it; smaller session ids first among equals."""
    top = F.broadcast(categories.select(F.col("category_id").alias("click_category_id")))  # the top few
    clicks = detail.join(top, "click_category_id", "left_semi")
    counts = clicks.groupBy(F.col("click_category_id").alias("category_id"), "session_id").agg(F.count("*").alias("click_count"))
    rank = F.row_number().over(W.partitionBy("category_id").orderBy(F.desc("click_count"), "session_id"))
    return counts.withColumn("__rank", rank).where(F.col("__rank") <= n).select(F.lit(task_id).cast("long").alias("task_id"), "category_id", "session_id", "click_count")


def distinct_categories(detail: DataFrame) -> DataFrame:
    """Every category clicked, ordered or paid."""
    return category_counts(detail).select("category_id")


