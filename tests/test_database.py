"""Keyed writes over JDBC against the embedded database that Spark's own jars hold."""

import uuid

import pytest

from clickloom.sources.database import Database
from clickloom.sources.sinks import append_jdbc
from clickloom.sources.tables import jdbc

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
STAT = "date string, province string, ad_id long, click_count long"


@pytest.fixture
def db(spark):
    return Database(spark, f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", {"driver": DRIVER})


def held(db, table):
    return sorted(tuple(r) for r in db.read(table).collect())


def test_upsert_replaces_and_inserts(spark, db):
    schema = "user_id long, name string, age int"  # nulls in numbers only: Spark sends null texts to this database as CLOB
    db.upsert(spark.createDataFrame([(1, "a", 10), (2, "b", 20)], schema), "users", ["user_id"])
    for _ in range(2):  # a write that is repeated changes nothing
        db.upsert(spark.createDataFrame([(2, "d", None), (3, "c", 30)], schema), "users", ["user_id"])
    assert held(db, "users") == [(1, "a", 10), (2, "d", None), (3, "c", 30)]
    db.upsert(spark.createDataFrame([], schema), "users", ["user_id"])
    assert db.read("users").count() == 3
    db.upsert(spark.createDataFrame([(4,), (5,)], "user_id long"), "listed", ["user_id"])
    db.upsert(spark.createDataFrame([(5,), (6,)], "user_id long"), "listed", ["user_id"])
    assert held(db, "listed") == [(4,), (5,), (6,)]


def test_upsert_refuses_bad_keys(spark, db):
    schema = "user_id long, name string"
    db.upsert(spark.createDataFrame([(1, "a")], schema), "users", ["user_id"])
    for bad in ([(None, "x")], [(1, "x"), (1, "y")]):
        with pytest.raises(ValueError):
            db.upsert(spark.createDataFrame(bad, schema), "users", ["user_id"])
    assert held(db, "users") == [(1, "a")]
    assert db.read("(SELECT tablename FROM sys.systables WHERE tabletype = 'T') t").count() == 1  # no staging table is left


def test_add_once_an_epoch(spark, db):
    keys = ["date", "province", "ad_id"]
    first = spark.createDataFrame([("d1", "p1", 1, 2), ("d1", "p1", 1, 3), ("d1", "p2", 1, None)], STAT)
    second = spark.createDataFrame([("d1", "p1", 1, 10), ("d2", "p1", 1, 7)], STAT)
    db.add(first, "ad_stat", keys, epoch=0)
    for _ in range(2):
        db.add(second, "ad_stat", keys, epoch=1)
    assert held(db, "ad_stat") == [("d1", "p1", 1, 15), ("d1", "p2", 1, 0), ("d2", "p1", 1, 7)]
    db.add(second, "ad_stat", keys)
    assert held(db, "ad_stat")[0] == ("d1", "p1", 1, 25)


def test_replace_groups(spark, db):
    keys = ["date", "province"]
    db.replace_groups(spark.createDataFrame([("d1", "p1", 1, 5), ("d1", "p1", 2, 4), ("d1", "p2", 3, 1)], STAT), "top3", keys)
    for _ in range(2):
        db.replace_groups(spark.createDataFrame([("d1", "p1", 9, 8)], STAT), "top3", keys)
    assert held(db, "top3") == [("d1", "p1", 9, 8), ("d1", "p2", 3, 1)]


def test_statements_and_plain_reads(spark, db):
    db.execute("CREATE TABLE city_info (city_id BIGINT PRIMARY KEY, city_name VARCHAR(20), area VARCHAR(20))")
    assert db.execute("INSERT INTO city_info VALUES (?, ?, ?)", 1, "x", "north") == 1
    append_jdbc(spark.range(2, 10).selectExpr("id AS city_id", "'y' AS city_name", "'south' AS area"), db.url, "city_info", db.properties)
    assert db.execute("UPDATE city_info SET city_name = ? WHERE city_id > ?", "z", 7) == 2
    assert db.execute("DELETE FROM city_info WHERE city_id = ?", 5) == 1
    split = jdbc(spark, db.url, "city_info", db.properties, "CITY_ID", (1, 10), 3)
    assert split.rdd.getNumPartitions() == 3 and split.count() == 8
    assert [r.CITY_ID for r in db.read("(SELECT city_id FROM city_info WHERE city_name = 'z') q").collect()] == [8, 9]
    # a table with its own names in capitals takes rows with names in small letters
    db.upsert(spark.createDataFrame([(1, "w", "east"), (20, "v", "west")], "city_id long, city_name string, area string"), "city_info", ["city_id"])
    assert {tuple(r) for r in db.read("city_info").where("city_id in (1, 20)").collect()} == {(1, "w", "east"), (20, "v", "west")}
