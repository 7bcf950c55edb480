"""Catalog tables of the batch jobs, laid out for them.

Actions lie in partitions by date and, within each, in buckets by session: a date range reads its own partitions only, and session aggregates and semi
joins by session need no exchange, as both sides come in the same buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SESSION = "session_id"


def save_actions(actions: DataFrame, table: str = "user_visit_action", buckets: int = 64, path: str | None = None) -> DataFrame:
    """Write actions as a table partitioned by date and bucketed by session, and read it; path: where, if not in the warehouse.

    Rows are dealt by the buckets' own hash first, so that each date has one file a bucket.
    """
    return _save(actions.repartition(buckets, SESSION), table, buckets, path, "date")


def save_sessions(sessions: DataFrame, table: str, buckets: int = 64, path: str | None = None) -> DataFrame:
    """Write a table with one row a session in the same buckets, and read it."""
    return _save(sessions.repartition(buckets, SESSION), table, buckets, path)


def save_plain(rows: DataFrame, table: str, path: str | None = None) -> DataFrame:
    """Write a dimension as a plain table, and read it."""
    writer = rows.write.mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return rows.sparkSession.table(table)


def _save(rows: DataFrame, table: str, buckets: int, path: str | None, by: str | None = None) -> DataFrame:
    writer = rows.write.mode("overwrite").format("parquet").bucketBy(buckets, SESSION).sortBy(SESSION)
    if by:
        writer = writer.partitionBy(by)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return rows.sparkSession.table(table).select(*rows.columns)


def drop(spark: SparkSession, *tables: str) -> None:
    for t in tables:
        spark.sql(f"DROP TABLE IF EXISTS {t}")
