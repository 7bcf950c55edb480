"""The most clicked products of each sales area."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickloom.functions.columns import area_level, concat_long_string, group_concat_distinct, product_status
from clickloom.operators.session import in_date_range


def product_clicks(actions: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """city_id and click_product_id of the clicks of a date range; the whole end day counts."""
    return in_date_range(actions, start, end).where(F.col("click_product_id").isNotNull()).select("city_id", "click_product_id")


def clicks_with_cities(clicks: DataFrame, cities: DataFrame) -> DataFrame:
    """Clicks with city and area; clicks of unknown cities go. Spark broadcasts the cities where they are small."""
    named = cities.select(F.col("city_id").cast("string").try_cast("long").alias("city_id"), "city_name", "area")
    return clicks.join(named, "city_id").select("city_id", "city_name", "area", F.col("click_product_id").alias("product_id"))


def area_product_clicks(clicks: DataFrame, cities: DataFrame) -> DataFrame:
    """area, product_id, click_count, city_infos ('id:name' of the cities, distinct and sorted).

    Clicks are counted by city and product before they meet the cities.
    """
    counted = clicks.groupBy("city_id", "click_product_id").agg(F.count("*").alias("n"))
    named = cities.select(F.col("city_id").cast("string").try_cast("long").alias("city_id"), "city_name", "area")
    info = concat_long_string(F.col("city_id"), F.col("city_name"), ":")
    return (
        counted.join(named, "city_id")
        .groupBy("area", F.col("click_product_id").alias("product_id"))
        .agg(F.sum("n").alias("click_count"), group_concat_distinct(info).alias("city_infos"))
    )


def with_products(counts: DataFrame, products: DataFrame) -> DataFrame:
    """Adds product_name and product_status; products without a record go, and so take no rank."""
    known = products.select("product_id", "product_name", product_status(F.col("extend_info")).alias("product_status"))
    return counts.join(known, "product_id")


def area_top_products(actions: DataFrame, cities: DataFrame, products: DataFrame, start: str | None = None, end: str | None = None, n: int = 3, task_id: int = 0) -> DataFrame:
    """The n most clicked products of each area; smaller product ids first among equals."""
    counts = with_products(area_product_clicks(product_clicks(actions, start, end), cities), products)
    rank = F.row_number().over(W.partitionBy("area").orderBy(F.desc("click_count"), "product_id"))
    return (
        counts.withColumn("__rank", rank)
        .where(F.col("__rank") <= n)
        .select(F.lit(task_id).cast("long").alias("task_id"), "area", area_level(F.col("area")).alias("area_level"), "product_id", "city_infos", "click_count", "product_name", "product_status")
    )
