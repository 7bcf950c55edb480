"""The sink that commits: killed and repeated tasks, repeated batches, streams."""

import os

import pytest
from pyspark.sql import functions as F

from clickloom.sources import committed
from clickloom.sources.tables import file_lines

SCHEMA = "k long, name string, day date, share double, at timestamp"


def frame(spark, a, b, parts=3):
    return spark.range(a, b, 1, parts).select(F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("n"), F.col("id").cast("string"))).alias("name"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"), (F.col("id") / 4).alias("share"), F.timestamp_seconds("id").alias("at"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(params=["", "file://"])
def path(spark, tmp_path, request):
    committed.register(spark)
    return f"{request.param}{tmp_path}/sink"


def test_batches_are_committed_once(spark, path):
    assert committed.read_committed(spark, path, SCHEMA).count() == 0
    for _ in range(2):  # the same batch again changes nothing
        frame(spark, 0, 10).write.format("committed").mode("append").option("batch", "b1").save(path)
    frame(spark, 10, 12).write.format("committed").mode("append").option("batch", "b2").save(path)
    assert rows(committed.read_committed(spark, path, SCHEMA)) == rows(frame(spark, 0, 12))
    frame(spark, 5, 6).write.format("committed").mode("overwrite").save(path)
    assert rows(committed.read_committed(spark, path, SCHEMA)) == rows(frame(spark, 5, 6))
    frame(spark, 0, 0).write.format("committed").mode("append").save(path)
    assert committed.read_committed(spark, path, SCHEMA).count() == 1


def test_a_failed_write_leaves_no_row(spark, path, tmp_path):
    frame(spark, 0, 4).write.format("committed").mode("append").save(path)
    broken = frame(spark, 0, 9).where(F.when(F.col("k") == 8, F.raise_error(F.lit("gone"))).otherwise(True).cast("boolean"))
    with pytest.raises(Exception):
        broken.write.format("committed").mode("append").save(path)
    assert rows(committed.read_committed(spark, path, SCHEMA)) == rows(frame(spark, 0, 4))


def test_a_task_that_ran_twice_counts_once(spark, path, tmp_path):
    """Two attempts of a task leave two files; the commit names the one whose message came back."""
    schema = frame(spark, 0, 1).schema
    writer = committed._StreamWriter(path, schema, "q")
    batches = frame(spark, 0, 5, 1).toArrow().to_batches()
    killed, done = writer.write(iter(batches)), writer.write(iter(batches))
    assert killed.name != done.name and len(os.listdir(tmp_path / "sink" / "data")) == 2
    writer.commit([done], 7)
    assert rows(committed.read_committed(spark, path, SCHEMA)) == rows(frame(spark, 0, 5))
    again = writer.write(iter(batches))
    writer.commit([again, committed.Written(None, 0), None], 7)  # the batch is run again: its commit stands, its new file goes
    assert rows(committed.read_committed(spark, path, SCHEMA)) == rows(frame(spark, 0, 5))
    assert len(os.listdir(tmp_path / "sink" / "data")) == 2
    writer.abort([writer.write(iter(batches))], 8)
    assert len(os.listdir(tmp_path / "sink" / "data")) == 2


def test_a_stream_of_several_batches(spark, path, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.txt").write_text(f"a{k}\nb{k}\n")
        os.utime(tmp_path / "in" / f"{k}.txt", (1_700_000_000 + k, 1_700_000_000 + k))
    lines = file_lines(spark, str(tmp_path / "in"), 1)
    for checkpoint in ("one", "one", "two"):  # a restart finds nothing new; a lost checkpoint runs the same batches again
        lines.writeStream.format("committed").option("path", path).option("query", "lines").option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start().awaitTermination()
    assert [r.value for r in committed.read_committed(spark, path, "value string").orderBy("value").collect()] == ["a0", "a1", "a2", "b0", "b1", "b2"]
    assert sorted(committed._commits(path)) == ["lines-0", "lines-1", "lines-2"]
