"""Keyed writes to a database over JDBC.

The rows are first written to a staging table, by all tasks in parallel. Set-based statements then move them into the target in one transaction of
one connection, so readers see all of a write or nothing of it, and a task that is retried repeats nothing. The statements are plain SQL
(UPDATE with a subquery, INSERT with NOT EXISTS), which databases without MERGE know too.

The driver's class path must hold the JDBC driver. Targets that do not exist are made with the rows' columns. Key columns must not
be null, and ``upsert`` and ``add`` take one row for each key; both are checked before the target is touched.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Database:
    """Where a database is; text columns of tables that are made here get the type ``text_type``."""

    spark: SparkSession
    url: str
    properties: dict[str, str] = field(default_factory=dict)
    text_type: str = "VARCHAR(255)"
    batch_size: int = 1000

    def read(self, table: str) -> DataFrame:
        """A table, or a query in parentheses with a name."""
        return self.spark.read.jdbc(self.url, table, properties=self.properties)

    def append(self, rows: DataFrame, table: str, mode: str = "append") -> None:
        """Append in batches of rows, one connection and transaction a partition."""
        text = ", ".join(f"`{f.name}` {self.text_type}" for f in rows.schema.fields if isinstance(f.dataType, T.StringType))
        writer = rows.write.option("batchsize", self.batch_size)
        (writer.option("createTableColumnTypes", text) if text else writer).jdbc(self.url, table, mode=mode, properties=self.properties)

    def execute(self, statement: str, *values) -> int:
        """Run one INSERT, UPDATE, DELETE or other statement with values for its question marks; the number of rows it changed."""
        with self._transaction() as run:
            return run(statement, *values)

    def upsert(self, rows: DataFrame, table: str, keys: list[str]) -> None:
        """Insert rows; those whose key is there replace the other columns."""
        with self._staged(rows, table, keys) as (source, name):
            values = [c for c in rows.columns if c not in keys]
            self._unique(source, name, keys)
            with self._transaction() as run:
                self._merge(run, rows.columns, table, source, name, keys, {c: f"(SELECT s.{name[c]} FROM {source} s WHERE {_match(table, name, keys)})" for c in values})

    def add(self, rows: DataFrame, table: str, keys: list[str], epoch: int | None = None) -> None:
        """Add the numbers of rows to those of equal keys; null counts as 0. With an epoch a batch that is written again changes nothing:
        ``<table>_epochs`` holds the epochs that were added, in the same transaction."""
        values = [c for c in rows.columns if c not in keys]
        summed = rows.groupBy(*keys).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast(rows.schema[c].dataType).alias(c) for c in values)).select(*rows.columns)
        ledger = f"{table}_epochs"
        if epoch is not None:
            self.append(self.spark.createDataFrame([], "epoch long"), ledger, "ignore")
            column = self._quote(self.read(ledger).columns[0])
        with self._staged(summed, table, keys) as (source, name), self._transaction() as run:
            if epoch is not None and not run(f"INSERT INTO {ledger} ({column}) SELECT DISTINCT CAST({int(epoch)} AS BIGINT) FROM {source} WHERE NOT EXISTS (SELECT 1 FROM {ledger} WHERE {column} = {int(epoch)})"):
                return  # there already, or no rows to add
            change = {c: f"COALESCE({table}.{name[c]}, 0) + (SELECT s.{name[c]} FROM {source} s WHERE {_match(table, name, keys)})" for c in values}
            self._merge(run, rows.columns, table, source, name, keys, change)

    def replace_groups(self, rows: DataFrame, table: str, keys: list[str], also: list[tuple] = ()) -> None:
        """Delete all rows of the groups that rows has, and of those given by the values of their keys in ``also``, then insert rows."""
        with self._staged(rows, table, keys) as (source, name), self._transaction() as run:
            for values in also:
                run(f"DELETE FROM {table} WHERE {' AND '.join(f'{name[k]} = ?' for k in keys)}", *values)
            run(f"DELETE FROM {table} WHERE EXISTS (SELECT 1 FROM {source} s WHERE {_match(table, name, keys)})")
            columns = ", ".join(name[c] for c in rows.columns)
            run(f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {source}")

    # inner steps

    def _quote(self, column: str) -> str:
        return self.spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(self.url).quoteIdentifier(column)

    @contextmanager
    def _transaction(self) -> Iterator:
        jvm = self.spark.sparkContext._jvm
        properties = jvm.java.util.Properties()
        for key, value in self.properties.items():
            properties.setProperty(key, value)
        if "driver" in self.properties:
            jvm.java.lang.Class.forName(self.properties["driver"])
        connection = jvm.java.sql.DriverManager.getConnection(self.url, properties)

        def run(statement: str, *values) -> int:
            prepared = connection.prepareStatement(statement)
            try:
                for k, value in enumerate(values, 1):
                    prepared.setObject(k, value)
                return prepared.executeUpdate()
            finally:
                prepared.close()

        try:
            connection.setAutoCommit(False)
            yield run
            connection.commit()
        except BaseException:
            connection.rollback()
            raise
        finally:
            connection.close()

    @contextmanager
    def _staged(self, rows: DataFrame, table: str, keys: list[str]) -> Iterator[tuple[str, dict[str, str]]]:
        """The staging table, and the quoted names that the target has for the columns of rows."""
        self.append(rows.limit(0), table, "ignore")
        there = {c.lower(): self._quote(c) for c in self.read(table).columns}
        name = {c: there[c.lower()] for c in rows.columns}
        source = f"{table}_{uuid.uuid4().hex[:12]}"
        # the staging table has the target's own names, so one quoted name serves both
        self.append(rows.toDF(*(next(t for t in self.read(table).columns if t.lower() == c.lower()) for c in rows.columns)), source, "overwrite")
        try:
            missing = " OR ".join(f"{name[k]} IS NULL" for k in keys)
            if self.read(f"(SELECT 1 AS x FROM {source} WHERE {missing}) bad").limit(1).count():
                raise ValueError(f"null in a key of {table}: {', '.join(keys)}")
            yield source, name
        finally:
            self.execute(f"DROP TABLE {source}")

    def _unique(self, source: str, name: dict[str, str], keys: list[str]) -> None:
        columns = ", ".join(name[k] for k in keys)
        if self.read(f"(SELECT {columns} FROM {source} GROUP BY {columns} HAVING COUNT(*) > 1) twice").limit(1).count():
            raise ValueError(f"several rows for one key: {', '.join(keys)}")

    def _merge(self, run, columns: list[str], table: str, source: str, name: dict[str, str], keys: list[str], change: dict[str, str]) -> None:
        match = _match(table, name, keys)
        if change:
            changes = ", ".join(f"{name[c]} = {x}" for c, x in change.items())
            run(f"UPDATE {table} SET {changes} WHERE EXISTS (SELECT 1 FROM {source} s WHERE {match})")
        own, theirs = ", ".join(name[c] for c in columns), ", ".join(f"s.{name[c]}" for c in columns)
        run(f"INSERT INTO {table} ({own}) SELECT {theirs} FROM {source} s WHERE NOT EXISTS (SELECT 1 FROM {table} WHERE {match})")


def _match(table: str, name: dict[str, str], keys: list[str]) -> str:
    return " AND ".join(f"{table}.{name[k]} = s.{name[k]}" for k in keys)
