"""Input tables.

Production tables come from the catalog, JDBC or Kafka. ``fixtures`` derives the same tables from the generated star schema, by integer
arithmetic alone, so that any SQL engine can form the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ACTION_SCHEMA = (
    "date string, user_id long, session_id string, page_id long, action_time string, search_keyword string, click_category_id long, "
    "click_product_id long, order_category_ids string, order_product_ids string, pay_category_ids string, pay_product_ids string, city_id long"
)
USER_SCHEMA = "user_id long, username string, name string, age int, professional string, city string, sex string"
PRODUCT_SCHEMA = "product_id long, product_name string, extend_info string"
CITY_SCHEMA = "city_id long, city_name string, area string"

# Session widths in days by user_id % 4, session spans in seconds by user_id % 7, areas by region key.
WIDTHS = (1, 3, 10, 30)
SPANS = (5, 8, 12, 50, 150, 900, 3600)
AREAS = ("华北", "华东", "华南", "西北", "东北")


@dataclass(frozen=True)
class Tables:
    """The inputs of the jobs."""

    actions: DataFrame
    users: DataFrame
    products: DataFrame
    cities: DataFrame
    ad_log: DataFrame


def _pick(c, values):
    out = F.when(c == 0, values[0])
    for k, v in enumerate(values[1:], 1):
        out = out.when(c == k, v)
    return out


def fixtures(spark: SparkSession, sf_dir: str, of: Column | None = None) -> Tables:
    """All input tables; with ``of``, actions and log of the events for which it holds."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    events = table("events").select("event_id", "user_id", "event_type", "ts", F.get_json_object("props", "$.k").cast("long").alias("k"))
    if of is not None:
        events = events.where(of)
    return Tables(
        actions=actions(events),
        users=table("customer").join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
            F.col("c_custkey").alias("user_id"),
            F.concat(F.lit("user"), F.col("c_custkey").cast("string")).alias("username"),
            F.col("c_name").alias("name"),
            (F.col("c_custkey") * 7 % 60).cast("int").alias("age"),
            F.col("c_mktsegment").alias("professional"),
            F.col("n_name").alias("city"),
            F.when(F.col("c_custkey") % 2 == 0, "male").otherwise("female").alias("sex"),
        ),
        products=table("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.concat(F.lit('{"product_status": '), (F.col("p_partkey") % 2).cast("string"), F.lit("}")).alias("extend_info"),
        ),
        cities=table("nation").select(
            F.col("n_nationkey").cast("long").alias("city_id"), F.col("n_name").alias("city_name"), _pick(F.col("n_regionkey"), AREAS).alias("area")
        ),
        ad_log=ad_log(events, table("nation"), table("region")),
    )


def actions(events: DataFrame) -> DataFrame:
    """user_visit_action rows from events (event_id, user_id, event_type, ts, k); event_id stays as the tie-breaker of equal seconds."""
    user, k = F.col("user_id"), F.col("k")
    width, span = _pick(user % 4, WIDTHS), _pick(user % 7, SPANS)
    part = F.floor((F.dayofmonth("ts") - 1) / width).cast("long")
    offset = (F.col("event_id") * 37 + k * 11) % span
    seconds = F.lit(1704067200) + part * width * 86400 + user % 23 * 3600 + offset  # from 2024-01-01 00:00:00 UTC
    time = F.timestamp_seconds(seconds)

    def when(kind: str, value):
        return F.when(F.col("event_type") == kind, value)

    return events.select(
        F.date_format(time, "yyyy-MM-dd").alias("date"),
        "user_id",
        F.concat_ws("_", user.cast("string"), part.cast("string")).alias("session_id"),
        (k % 10).alias("page_id"),
        F.date_format(time, "yyyy-MM-dd HH:mm:ss").alias("action_time"),
        when("view", F.concat(F.lit("kw"), (k % 10).cast("string"))).alias("search_keyword"),
        when("click", k).alias("click_category_id"),
        when("click", (F.col("event_id") * 13 + k) % 200).alias("click_product_id"),
        when("purchase", F.concat_ws(",", k.cast("string"), ((k + 1) % 100).cast("string"))).alias("order_category_ids"),
        when("purchase", (F.col("event_id") % 200).cast("string")).alias("order_product_ids"),
        when("signup", k.cast("string")).alias("pay_category_ids"),
        when("signup", (F.col("event_id") % 200).cast("string")).alias("pay_product_ids"),
        (user % 25).alias("city_id"),
        "event_id",
    )


def ad_log(events: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Lines 'epochMillis province city userid adid'."""
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("place"), F.replace("r_name", F.lit(" "), F.lit("-")).alias("province"), F.replace(F.replace("n_name", F.lit("_"), F.lit("-")), F.lit(" "), F.lit("-")).alias("city")
    )
    return events.join(place, F.col("user_id") % 25 == F.col("place")).select(
        F.concat_ws(" ", F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), "province", "city", F.col("user_id").cast("string"), (F.col("k") % 10).cast("string")).alias("value")
    )


def from_catalog(spark: SparkSession, cities: DataFrame, ad_lines: DataFrame) -> Tables:
    """Tables of the session's catalog (Hive, if the session has it); cities usually come from jdbc()."""
    return Tables(spark.table("user_visit_action"), spark.table("user_info"), spark.table("product_info"), cities, ad_lines)


def jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str], column: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 1) -> DataFrame:
    """A JDBC table; credentials go in properties. With column and bounds the read is split into parts."""
    if column is None:
        return spark.read.jdbc(url, table, properties=properties)
    return spark.read.jdbc(url, table, column=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts, properties=properties)


def kafka_lines(spark: SparkSession, servers: str, topics: str, **options: str) -> DataFrame:
    """A stream of text values from comma-separated Kafka topics (needs the Kafka package on the class path)."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics)
    return reader.options(**options).load().select(F.col("value").cast("string").alias("value"))


def file_lines(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of text lines from a folder."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path)


def generated_lines(spark: SparkSession, per_second: int = 10) -> DataFrame:
    """A stream of ad-log lines for trials: five provinces of two cities, users 0-999, ads 0-9."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    mixed = F.xxhash64("value")
    province = F.pmod(mixed, F.lit(5)).cast("string")
    return rows.select(
        F.concat_ws(
            " ",
            F.unix_millis("timestamp").cast("string"),
            F.concat(F.lit("province"), province),
            F.concat(F.lit("city"), province, F.pmod(F.shiftright(mixed, 8), F.lit(2)).cast("string")),
            F.pmod(F.shiftright(mixed, 16), F.lit(1000)).cast("string"),
            F.pmod(F.shiftright(mixed, 32), F.lit(10)).cast("string"),
        ).alias("value")
    )
