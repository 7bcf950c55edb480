"""The registered queries over the derived input tables, and the same in SQL."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickloom.functions import columns as C
from clickloom.operators import ads, bloom, pageflow, product, session, skew, trend
from clickloom.params import Settings, TaskParams
from clickloom.sources import catalog
from clickloom.sources.sinks import EpochStore, append
from clickloom.sources.tables import file_lines, fixtures
from clickloom.streaming.ads_stream import AdStream
from clickloom.streaming.state import DAY_MS

TASK = TaskParams.from_json(
    '{"startDate": ["2024-01-01"], "endDate": ["2024-01-31"], "startAge": ["10"], "endAge": ["50"], "sex": ["male"], '
    '"keywords": ["kw0,kw1,kw2,kw3,kw4,kw5,kw6"], "targetPageFlow": ["1,2,3,4,5,6,7"]}',
    task_id=1,
)
FLOW = TASK.target_page_flow
THRESHOLD = 3  # the derived clicks repeat at most four times by day, user and ad


def _filtered(spark: SparkSession, sf_dir: str):
    t = fixtures(spark, sf_dir)
    return t, session.filtered_sessions(t.actions, t.users, TASK)


def _detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, sessions = _filtered(spark, sf_dir)
    return session.session_detail(session.in_date_range(t.actions, TASK.start_date, TASK.end_date), sessions)


def actions_in_range(spark, sf_dir):
    return session.in_date_range(fixtures(spark, sf_dir).actions, "2024-01-05", "2024-01-20")


def user_info(spark, sf_dir):
    return fixtures(spark, sf_dir).users


def product_info(spark, sf_dir):
    rows = fixtures(spark, sf_dir).products
    return rows.withColumn("product_status", C.product_status(F.col("extend_info")))


def city_info(spark, sf_dir):
    rows = fixtures(spark, sf_dir).cities
    return rows.withColumn("area_level", C.area_level(F.col("area")))


def session_aggregates(spark, sf_dir):
    return session.session_aggregates(fixtures(spark, sf_dir).actions)


def session_filter(spark, sf_dir):
    return _filtered(spark, sf_dir)[1]


def session_histogram(spark, sf_dir):
    return session.session_histogram(session.session_aggregates(fixtures(spark, sf_dir).actions))


def session_aggr_stat(spark, sf_dir):
    return session.session_aggr_stat(_filtered(spark, sf_dir)[1], TASK.task_id)


def sessions_per_hour(spark, sf_dir):
    return session.sessions_per_hour(_filtered(spark, sf_dir)[1])


def session_sample_quotas(spark, sf_dir):
    return session.sample_quotas(_filtered(spark, sf_dir)[1])


def session_random_extract(spark, sf_dir):
    return session.sample_sessions(_filtered(spark, sf_dir)[1], task_id=TASK.task_id)


def session_random_extract_detail(spark, sf_dir):
    t, sessions = _filtered(spark, sf_dir)
    drawn = session.sample_sessions(sessions, task_id=TASK.task_id)
    return session.detail_of(session.in_date_range(t.actions, TASK.start_date, TASK.end_date), drawn, TASK.task_id)


def session_detail(spark, sf_dir):
    return _detail(spark, sf_dir)


def category_counts(spark, sf_dir):
    return session.category_counts(_detail(spark, sf_dir))


def top10_category(spark, sf_dir):
    return session.top_categories(_detail(spark, sf_dir), task_id=TASK.task_id)


def top10_session(spark, sf_dir):
    detail = _detail(spark, sf_dir)
    return session.top_category_sessions(detail, session.top_categories(detail), task_id=TASK.task_id)


def top10_session_detail(spark, sf_dir):
    detail = _detail(spark, sf_dir)
    top = session.top_category_sessions(detail, session.top_categories(detail))
    return session.detail_of(detail, top, TASK.task_id)


def page_slice_counts(spark, sf_dir):
    return pageflow.slice_counts(fixtures(spark, sf_dir).actions, FLOW)


def page_start_pv(spark, sf_dir):
    return pageflow.start_page_pv(fixtures(spark, sf_dir).actions, FLOW)


def page_split_convert_rate(spark, sf_dir):
    return pageflow.conversion_rates(fixtures(spark, sf_dir).actions, FLOW)


def page_convert_rate_text(spark, sf_dir):
    rates = pageflow.conversion_rates(fixtures(spark, sf_dir).actions, FLOW)
    return pageflow.conversion_text(rates.withColumn("convert_rate", F.format_number("convert_rate", 2)), TASK.task_id)


def area_product_clicks(spark, sf_dir):
    t = fixtures(spark, sf_dir)
    return product.area_product_clicks(product.product_clicks(t.actions, "2024-01-01", "2024-01-31"), t.cities)


def area_top3_product(spark, sf_dir):
    t = fixtures(spark, sf_dir)
    return product.area_top_products(t.actions, t.cities, t.products, "2024-01-01", "2024-01-31", task_id=TASK.task_id)


def _clicks(spark, sf_dir):
    return ads.parse_log(fixtures(spark, sf_dir).ad_log)


def ad_log(spark, sf_dir):
    return _clicks(spark, sf_dir)


def ad_user_click_count(spark, sf_dir):
    return ads.user_click_counts(_clicks(spark, sf_dir))


def ad_blacklist(spark, sf_dir):
    return ads.blacklisted_users(ads.user_click_counts(_clicks(spark, sf_dir)), THRESHOLD)


def _allowed(spark, sf_dir):
    clicks = _clicks(spark, sf_dir)
    return ads.without_blacklisted(clicks, ads.blacklisted_users(ads.user_click_counts(clicks), THRESHOLD))


def ad_stat(spark, sf_dir):
    return ads.click_stat(_allowed(spark, sf_dir))


def ad_province_count(spark, sf_dir):
    return ads.province_counts(ads.click_stat(_allowed(spark, sf_dir)))


def ad_province_top3(spark, sf_dir):
    return ads.province_top(ads.click_stat(_allowed(spark, sf_dir)))


def ad_click_trend(spark, sf_dir):
    return ads.click_trend(_clicks(spark, sf_dir))


def _shared(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one where that is unset and the master is local, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="clickloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        shared = f"file://{folder}"
    return shared.rstrip("/")


def _scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    atexit.register(_remove, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()))
    return path


def _remove(where, files) -> None:
    with contextlib.suppress(Exception):  # the gateway may have ended before
        files.delete(where, True)


BATCHES = 5


def _log_files(spark: SparkSession, sf_dir: str, base: str, batch, files: int = 4) -> DataFrame:
    """The log as a stream of files in batches, in order; batch: the number of an event's batch."""
    for k in range(BATCHES):
        fixtures(spark, sf_dir, batch == k).ad_log.repartition(files).write.mode("append").text(f"{base}/in")
    return file_lines(spark, f"{base}/in", files)


def _streamed(spark: SparkSession, sf_dir: str) -> AdStream:
    """The whole stream over the log, batch by batch; every batch has clicks of every day."""
    base = _scratch(spark, "ads")
    stream = AdStream(spark, f"{base}/out", Settings(blacklist_threshold=THRESHOLD), fanout=4, keep_ms=31 * DAY_MS)
    stream.start(_log_files(spark, sf_dir, base, F.col("event_id") % BATCHES), f"{base}/checkpoint", once=True).awaitTermination()
    return stream


def stream_ad_blacklist(spark, sf_dir):
    return _streamed(spark, sf_dir).blacklisted()


def stream_ad_stat(spark, sf_dir):
    return _streamed(spark, sf_dir).stat_totals()


def stream_ad_province_top3(spark, sf_dir):
    return _streamed(spark, sf_dir).province_top()


def stream_ad_click_trend(spark, sf_dir):
    return _streamed(spark, sf_dir).trend_totals()


def stream_ad_user_click_count(spark, sf_dir):
    return _streamed(spark, sf_dir).user_click_totals()


def stream_trend_intervals(spark, sf_dir):
    """The sliding trend of the log streamed in order of time, an hour every ten seconds: the panes that the watermark has passed, an hour behind, as
    runs of windows of equal count."""
    base = _scratch(spark, "trend")
    stream = AdStream(spark, f"{base}/out", fanout=4)
    stream.start_trend(_log_files(spark, sf_dir, base, F.floor((F.dayofmonth("ts") - 1) / 6)), f"{base}/checkpoint", once=True).awaitTermination()
    return stream.trend_intervals()


def scalar_functions(spark, sf_dir):
    a = fixtures(spark, sf_dir).actions
    time, c = C.as_time(F.col("action_time")), F.col
    date, hour, minute = C.split_minute_key(C.minute_key(time))
    record = F.concat(F.lit("session="), c("session_id"), F.lit("|page="), c("page_id").cast("string"), F.lit("|empty=|bad=1=2"))
    return a.select(
        "event_id",
        C.is_empty(c("search_keyword")).alias("no_keyword"),
        C.trim_comma(F.concat(F.lit(","), F.coalesce("order_category_ids", F.lit("")), F.lit(","))).alias("trimmed"),
        C.two_digits(c("page_id").cast("string")).alias("two_digits"),
        C.concat_field(record, "|", "page").alias("page"),
        C.concat_field(record, "|", "empty").alias("empty_field"),
        C.concat_field(record, "|", "bad").alias("bad_field"),
        C.set_concat_field(record, "|", "page", F.lit("x")).alias("changed"),
        C.before(c("action_time"), F.lit("2024-01-10 00:00:00")).alias("is_before"),
        C.after(c("action_time"), F.lit("no time")).alias("is_after"),
        C.minus_seconds(c("action_time"), F.lit("2024-01-01 00:00:00")).alias("seconds"),
        C.date_hour(c("action_time")).alias("date_hour"),
        C.date_key(time).alias("date_key"),
        F.date_format(C.parse_date_key(C.date_key(time)), "yyyy-MM-dd").alias("parsed_key"),
        C.minute_key(time).alias("minute_key"),
        date.alias("key_date"),
        hour.alias("key_hour"),
        minute.alias("key_minute"),
        C.round_half_up(C.ratio(c("page_id"), c("city_id"))).alias("rounded"),
        C.concat_long_string(c("click_category_id"), c("search_keyword"), ":").alias("joined"),
    )


def category_ids_distinct(spark, sf_dir):
    return session.distinct_categories(_detail(spark, sf_dir))


def _sessions_with_users(spark, sf_dir):
    t = fixtures(spark, sf_dir)
    return session.session_aggregates(t.actions).select("session_id", "user_id", "step_length"), t.users.select("user_id", "age", "city")


def join_broadcast(spark, sf_dir):
    return skew.broadcast_join(*_sessions_with_users(spark, sf_dir), "user_id")


def join_salted(spark, sf_dir):
    return skew.salted_join(*_sessions_with_users(spark, sf_dir), "user_id")


def join_split_skew(spark, sf_dir):
    left, right = _sessions_with_users(spark, sf_dir)
    hot = [r.user_id for r in skew.hot_keys(left, "user_id").collect()]  # one key
    return skew.split_join(left, right, "user_id", hot)


def two_stage_count(spark, sf_dir):
    clicks = _detail(spark, sf_dir).where("click_category_id is not null").select("click_category_id", "session_id", "action_time")
    return skew.two_stage_count(clicks, "click_category_id").withColumnRenamed("n", "click_count")


def skew_sample(spark, sf_dir):
    """The most frequent keys of a sample drawn by a hash of the session."""
    return skew.hot_keys(_sessions_with_users(spark, sf_dir)[0], "user_id", n=10, by="session_id")


def heavy_hitters(spark, sf_dir):
    """Users with at least one in five hundred of the actions, found by a sketch and counted exactly."""
    return skew.heavy_hitters(fixtures(spark, sf_dir).actions, "user_id", 0.002)


def _drop(spark: SparkSession, *tables: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        catalog.drop(spark, *tables)


def _laid_out(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Actions and the filtered sessions as catalog tables in the same buckets."""
    t, name = fixtures(spark, sf_dir), f"clickloom_{uuid.uuid4().hex}"
    tables = (f"{name}_actions", f"{name}_sessions")
    atexit.register(_drop, spark, *tables)
    actions = catalog.save_actions(t.actions, tables[0], 8, _scratch(spark, "actions"))
    sessions = session.filtered_sessions(actions, t.users, TASK)
    return actions, catalog.save_sessions(sessions, tables[1], 8, _scratch(spark, "sessions"))


def bucketed_session_detail(spark, sf_dir):
    """All actions of the filtered sessions, by a join that exchanges neither side."""
    actions, sessions = _laid_out(spark, sf_dir)
    return session.session_detail(session.in_date_range(actions, TASK.start_date, TASK.end_date), sessions)


def bloom_session_detail(spark, sf_dir):
    """The same with a Bloom filter of the sessions below the exchange of the actions."""
    t, sessions = _filtered(spark, sf_dir)
    return bloom.bloom_semi_join(session.in_date_range(t.actions, TASK.start_date, TASK.end_date), sessions, "session_id")


def observed_session_aggr_stat(spark, sf_dir):
    """The histogram's shares from metrics of the pass that writes the sessions."""
    sessions, counts = session.observed_histogram(_filtered(spark, sf_dir)[1])
    sessions.write.parquet(_scratch(spark, "sessions"))
    return session.observed_aggr_stat(spark, counts.get, TASK.task_id)


def task_session_filter(spark, sf_dir):
    """The sessions of a task found by its id in a table of tasks, one for each nation: its city, a range of days and of ages."""
    text = F.concat(F.lit('{"startDate": ["2024-01-05"], "endDate": ["2024-01-25", "x"], "startAge": ["10"], "endAge": ["50"], "sex": [" "], "cities": ["'), "n_name", F.lit('"]}'))
    tasks = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("task_id"), text.alias("task_param"))
    t = fixtures(spark, sf_dir)
    return session.filtered_sessions(t.actions, t.users, TaskParams.from_table(tasks, 11))


def json_items(spark, sf_dir):
    """A field of an object in a JSON array."""
    p = fixtures(spark, sf_dir).products
    text = F.concat(F.lit('[{"name": "first", "id": 1}, {"name": "'), F.col("product_name"), F.lit('", "id": '), F.col("product_id").cast("string"), F.lit("}]"))
    return p.select("product_id", C.json_array_item(text, 1, "name").alias("name"), C.json_array_item(text, 2, "name").alias("beyond"))


def date_functions(spark, sf_dir):
    """Date and time as text, and that yesterday is a day before today."""
    t = C.as_time(F.col("action_time"))
    days = F.datediff(C.today().cast("date"), C.yesterday().cast("date")).alias("days")
    return fixtures(spark, sf_dir).actions.select("event_id", C.format_date(t).alias("date_text"), C.format_time(t).alias("time_text"), days)


def session_filter_all(spark, sf_dir):
    """Sessions by profession, city and clicked category."""
    t = fixtures(spark, sf_dir)
    cities = tuple(r.city for r in t.users.select("city").distinct().orderBy("city").limit(15).collect())  # of 25
    task = TaskParams(professionals=("BUILDING", "MACHINERY", "FURNITURE"), cities=cities, category_ids=tuple(range(60)))
    return session.filtered_sessions(t.actions, t.users, task)


def ad_blacklist_100(spark, sf_dir):
    """Users with 100 or more clicks on one ad a day; the derived clicks count forty times here."""
    counts = ads.user_click_counts(_clicks(spark, sf_dir)).withColumn("click_count", F.col("click_count") * 40)
    return ads.blacklisted_users(counts)


def ad_sliding_trend(spark, sf_dir):
    """Clicks by windows of an hour every ten minutes, event minute and ad, from panes."""
    return trend.sliding_windows(_trend_intervals(spark, sf_dir, "10 minutes"), slide="10 minutes")


def _trend_intervals(spark: SparkSession, sf_dir: str, slide: str) -> DataFrame:
    return trend.trend_intervals(trend.panes(_clicks(spark, sf_dir), slide), slide=slide)


def ad_trend_intervals(spark, sf_dir):
    """Clicks by windows of an hour every ten seconds, event minute and ad: runs of windows of equal count."""
    return _trend_intervals(spark, sf_dir, "10 seconds")


def _store(spark: SparkSession, name: str, schema: str) -> EpochStore:
    return EpochStore(spark, _scratch(spark, name), schema)


def store_latest(spark, sf_dir):
    """A keyed store in which later epochs replace values; writing an epoch again changes nothing."""
    counts = ads.province_counts(ads.click_stat(_clicks(spark, sf_dir))).groupBy("date", "ad_id").agg(F.sum("click_count").alias("click_count"))
    store = _store(spark, "latest", "date string, ad_id long, click_count long")
    store.write(counts, 0)
    for _ in range(2):
        store.write(counts.where("ad_id < 5").withColumn("click_count", F.col("click_count") * 10), 1)
    return store.latest(["date", "ad_id"], "click_count")


def append_twice(spark, sf_dir):
    """Rows appended to a table in two writes."""
    path = _scratch(spark, "append")
    products = fixtures(spark, sf_dir).products.select("product_id", "product_name")
    append(products.where("product_id % 2 = 0"), path)
    append(products.where("product_id % 3 = 0"), path)
    return spark.read.schema(products.schema).parquet(path)


def customer_grades(spark, sf_dir):
    """Searched CASE, IF and row_number: customers graded by balance and ranked within their nation."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("class"), F.floor(F.col("c_acctbal") / 100).cast("long").alias("grade"))
    g = F.col("grade")
    level = F.when(g >= 90, "A").when(g >= 80, "B").when(g >= 70, "C").otherwise("D")
    rank = F.row_number().over(W.partitionBy("class").orderBy(F.desc("grade"), "user_id"))
    return rows.select("user_id", "class", "grade", level.alias("level"), F.when(g >= 80, "GOOD").otherwise("BAD").alias("verdict"), rank.alias("rank"))


QUERIES = {
    f.__name__: f
    for f in (
        actions_in_range, user_info, product_info, city_info, session_aggregates, session_filter, session_histogram, session_aggr_stat, sessions_per_hour, session_sample_quotas,
        session_random_extract, session_random_extract_detail, session_detail, category_counts, top10_category, top10_session, top10_session_detail, page_slice_counts, page_start_pv,
        page_split_convert_rate, page_convert_rate_text, area_product_clicks, area_top3_product, ad_log, ad_user_click_count, ad_blacklist, ad_stat, ad_province_count, ad_province_top3,
        ad_click_trend, stream_ad_blacklist, stream_ad_stat, stream_ad_province_top3, stream_ad_click_trend, stream_ad_user_click_count, stream_trend_intervals, ad_trend_intervals, heavy_hitters, bucketed_session_detail, bloom_session_detail, observed_session_aggr_stat, scalar_functions, category_ids_distinct, join_broadcast, join_salted,
        join_split_skew, two_stage_count, skew_sample, customer_grades, task_session_filter, json_items, date_functions, session_filter_all, ad_blacklist_100, ad_sliding_trend,
        store_latest, append_twice,
    )
}
