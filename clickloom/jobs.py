"""The jobs as programs: arguments to a task, its results written as tables.

``python -m clickloom.jobs session --task-id 1 --tables FOLDER --out FOLDER`` runs a job on Parquet tables of a folder; without --tables it reads
the catalog (with --hive the Hive metastore's). ``tables`` puts the tables of a folder into the catalog, actions by date and session.
With --jdbc results also go to a database, and --jdbc-tables names inputs that come from it. ``ads`` runs the stream, on lines of a folder or of Kafka.
The master is that of spark-submit unless --master names one.
Results lie in ``out/<table>/task_id=<id>``, and a job that is run again replaces its own.
"""

from __future__ import annotations

import argparse
import dataclasses
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.operators import pageflow, product, session
from clickloom.params import Settings, TaskParams
from clickloom.sources import catalog
from clickloom.sources.database import Database
from clickloom.sources.tables import Tables, from_catalog, kafka_lines
from clickloom.streaming.ads_stream import AdStream

Results = Iterator[tuple[str, DataFrame]]
Keep = Callable[[DataFrame], DataFrame]


def session_results(tables: Tables, task: TaskParams, settings: Settings, keep: Keep) -> Results:
    """Histogram, sampled sessions with detail, top categories, and their top sessions with detail.

    Sessions and their actions are written once and read by all reports; the histogram is taken while the sessions are written.
    """
    actions = session.in_date_range(tables.actions, task.start_date, task.end_date)
    sessions, counts = session.observed_histogram(session.filtered_sessions(tables.actions, tables.users, task))
    sessions = keep(sessions)
    yield "session_aggr_stat", session.observed_aggr_stat(sessions.sparkSession, counts.get, task.task_id)
    drawn = keep(session.sample_sessions(sessions, settings.sample_sessions, settings.seed, task.task_id))
    yield "session_random_extract", drawn
    yield "session_random_extract_detail", session.detail_of(actions, drawn, task.task_id)
    detail = keep(session.session_detail(actions, sessions))
    categories = session.top_categories(detail, settings.top_categories, task.task_id)
    yield "top10_category", categories
    top = keep(session.top_category_sessions(detail, categories, settings.top_sessions, task.task_id))
    yield "top10_session", top
    yield "top10_session_detail", session.detail_of(detail, top, task.task_id)


def pageflow_results(tables: Tables, task: TaskParams, settings: Settings, keep: Keep) -> Results:
    actions = session.in_date_range(tables.actions, task.start_date, task.end_date)
    rates = pageflow.conversion_rates(actions, task.target_page_flow)
    yield "page_split_convert_rate", pageflow.conversion_text(rates, task.task_id)


def product_results(tables: Tables, task: TaskParams, settings: Settings, keep: Keep) -> Results:
    yield "area_top3_product", product.area_top_products(tables.actions, tables.cities, tables.products, task.start_date, task.end_date, settings.top_products, task.task_id)


JOBS = {"session": session_results, "pageflow": pageflow_results, "product": product_results}


def run(job: str, tables: Tables, task: TaskParams, out: str, settings: Settings = Settings(), database: Database | None = None) -> list[str]:
    """Run a job and write its results; their table names. In a database a result replaces the task's rows of before."""
    written, spark = [], tables.actions.sparkSession
    work = f"{out}/_work-{uuid.uuid4().hex}"

    def keep(rows: DataFrame) -> DataFrame:
        path = f"{work}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    try:
        for name, rows in JOBS[job](tables, task, settings, keep):
            rows.drop("task_id").write.mode("overwrite").parquet(f"{out}/{name}/task_id={task.task_id}")
            if database is not None:
                found = spark.read.schema(rows.drop("task_id").schema).parquet(f"{out}/{name}/task_id={task.task_id}").select(F.lit(task.task_id).cast("long").alias("task_id"), "*")
                database.replace_groups(found, name, ["task_id"], [(task.task_id,)])
            written.append(name)
    finally:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return written


def open_session(name: str, master: str | None = None, hive: bool = False) -> SparkSession:
    """A session on the given master, or on that of spark-submit; with the Hive metastore if asked for."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return (builder.enableHiveSupport() if hive else builder).getOrCreate()


def from_folder(spark: SparkSession, folder: str) -> Tables:
    """The input tables as Parquet; the ad stream has its own source."""

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}")

    return Tables(read("user_visit_action"), read("user_info"), read("product_info"), read("city_info"), spark.createDataFrame([], "value string"))


def save_tables(tables: Tables, path: str | None = None) -> None:
    """Put the input tables into the catalog; path: a folder for them, if not the warehouse."""

    def at(name: str) -> str | None:
        return f"{path}/{name}" if path else None

    catalog.save_actions(tables.actions, path=at("user_visit_action"))
    for name, rows in (("user_info", tables.users), ("product_info", tables.products), ("city_info", tables.cities)):
        catalog.save_plain(rows, name, at(name))


def main(arguments: list[str] | None = None) -> list[str]:
    parser = argparse.ArgumentParser(prog="clickloom.jobs", description=__doc__)
    parser.add_argument("job", choices=[*JOBS, "ads", "tables"])
    parser.add_argument("--task-id", type=int, help="row of the task table; not for ads and tables")
    parser.add_argument("--tables", help="folder of Parquet tables (user_visit_action, user_info, product_info, city_info, task); the catalog if left out")
    parser.add_argument("--lines", help="ads: folder of text files with log lines")
    parser.add_argument("--kafka", help="ads: bootstrap servers of the log, instead of --lines")
    parser.add_argument("--topics", help="ads: comma-separated Kafka topics")
    parser.add_argument("--out", required=True, help="folder of the results")
    parser.add_argument("--once", action="store_true", help="ads: take what is there and end")
    parser.add_argument("--jdbc", help="URL of a database that gets the results too")
    parser.add_argument("--jdbc-option", action="append", default=[], metavar="NAME=VALUE", help="driver, user and other connection properties")
    parser.add_argument("--jdbc-tables", nargs="*", default=[], choices=["city_info", "task"], help="inputs that are read from the database")
    parser.add_argument("--master")
    parser.add_argument("--hive", action="store_true")
    given = parser.parse_args(arguments)
    if given.job == "ads" and not (given.lines or given.kafka and given.topics):
        parser.error("ads needs --lines, or --kafka and --topics")
    if given.job in JOBS and given.task_id is None:
        parser.error(f"{given.job} needs --task-id")
    if given.job == "tables" and not given.tables:
        parser.error("tables needs --tables")
    if given.jdbc_tables and not given.jdbc:
        parser.error("--jdbc-tables needs --jdbc")
    spark, out = open_session(f"clickloom-{given.job}", given.master, given.hive), given.out.rstrip("/")
    database = Database(spark, given.jdbc, dict(x.split("=", 1) for x in given.jdbc_option)) if given.jdbc else None
    if given.job == "ads":
        lines = kafka_lines(spark, given.kafka, given.topics) if given.kafka else spark.readStream.text(given.lines)
        AdStream(spark, out, database=database).start(lines, f"{out}/checkpoint", given.once).awaitTermination()
        return []
    if given.job == "tables":
        save_tables(from_folder(spark, given.tables), out)
        return []

    def source(name: str) -> DataFrame:
        if name in given.jdbc_tables:
            found = database.read(name)
            return found.toDF(*(c.lower() for c in found.columns))
        return spark.read.parquet(f"{given.tables}/{name}") if given.tables else spark.table(name)

    task = TaskParams.from_table(source("task"), given.task_id)
    cities = source("city_info")
    tables = dataclasses.replace(from_folder(spark, given.tables), cities=cities) if given.tables else from_catalog(spark, cities, spark.createDataFrame([], "value string"))
    return run(given.job, tables, task, out, database=database)


if __name__ == "__main__":
    main()
