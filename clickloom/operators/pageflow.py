"""Page-flow conversion: how many of the visits of a page go on to the next page of a target path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickloom.functions.columns import page_slices, ratio, round_half_up


def page_pairs(actions: DataFrame) -> DataFrame:
    """Consecutive pages of each session as page_split 'a_b'; equal seconds are ordered by event_id, then page."""
    tie = ["event_id"] if "event_id" in actions.columns else []
    order = W.partitionBy("session_id").orderBy("action_time", *tie, "page_id")
    pairs = actions.select("session_id", F.lag("page_id").over(order).alias("a"), F.col("page_id").alias("b"))
    return pairs.where("a is not null and b is not null").select("session_id", F.concat_ws("_", F.col("a").cast("string"), F.col("b").cast("string")).alias("page_split"))


def slice_counts(actions: DataFrame, flow: tuple[int, ...]) -> DataFrame:
    """page_split and pv for the steps of the path that occur; every occurrence counts, and no earlier step is required."""
    return page_pairs(actions).where(F.col("page_split").isin(*page_slices(flow))).groupBy("page_split").agg(F.count("*").alias("pv"))


def start_page_pv(actions: DataFrame, flow: tuple[int, ...]) -> DataFrame:
    """One row: visits of the path's first page."""
    return actions.where(F.col("page_id") == flow[0]).agg(F.count("*").alias("pv"))


def conversion_rates(actions: DataFrame, flow: tuple[int, ...]) -> DataFrame:
    """step, page_split, pv, base (visits one step before), rate to two decimals: first step against the start page, later ones against
    the step before. A step without visits has pv 0; a rate against 0 is null.
    """
    spark: SparkSession = actions.sparkSession
    if len(flow) < 2:
        return spark.createDataFrame([], "step int, page_split string, pv long, base long, convert_rate double")
    steps = spark.createDataFrame(list(enumerate(page_slices(flow), 1)), "step int, page_split string")
    start = spark.createDataFrame([(0, None)], "step int, page_split string")
    # one pass: pairs and start-page visits are counted together
    tie = ["event_id"] if "event_id" in actions.columns else []
    order = W.partitionBy("session_id").orderBy("action_time", *tie, "page_id")
    seen = actions.select("page_id", F.lag("page_id").over(order).alias("a"))
    pair = F.concat_ws("_", F.col("a").cast("string"), F.col("page_id").cast("string"))
    marks = seen.select(F.when(F.col("a").isNotNull() & F.col("page_id").isNotNull() & pair.isin(*page_slices(flow)), pair).alias("page_split"), (F.col("page_id") == flow[0]).alias("starts"))
    counts = marks.where("page_split is not null or starts").groupBy("page_split").agg(F.count("*").alias("n"), F.count_if("starts").alias("starts"))
    first = counts.agg(F.sum("starts").alias("pv")).select(F.lit(0).alias("step"), F.coalesce("pv", F.lit(0)).alias("pv"))
    later = steps.join(counts, "page_split", "left").select("step", F.coalesce("n", F.lit(0)).alias("pv"))
    line = first.unionByName(later).join(start.unionByName(steps), "step")
    # a row per step of the path
    base = F.lag("pv").over(W.orderBy("step"))
    rated = line.withColumn("base", base).where("step > 0")
    return rated.select("step", "page_split", "pv", "base", round_half_up(ratio(F.col("pv"), F.col("base"))).alias("convert_rate"))


def conversion_text(rates: DataFrame, task_id: int = 0) -> DataFrame:
    """One row: 'a_b=0.12|b_c=0.3' in path order; a missing rate reads 'null'."""
    part = F.concat(F.col("page_split"), F.lit("="), F.coalesce(F.col("convert_rate").cast("string"), F.lit("null")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("step", part.alias("part")))), lambda x: x["part"])
    return rates.agg(F.array_join(parts, "|").alias("convert_rate")).select(F.lit(task_id).cast("long").alias("task_id"), "convert_rate")
