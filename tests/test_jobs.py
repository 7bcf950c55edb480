"""Jobs run as programs on tables of a folder equal the operators' results."""

import os
import uuid

import pytest

from clickloom import jobs
from clickloom.operators import pageflow, product, session
from clickloom.params import Settings, TaskNotFound, TaskParams
from clickloom.sources import catalog
from clickloom.sources.database import Database
from clickloom.sources.tables import fixtures

SF = "/root/testdata/sf0.001"
TEXT = '{"startDate": ["2024-01-01"], "endDate": ["2024-01-31"], "sex": ["male"], "targetPageFlow": ["1,2,3,4"]}'


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base, t = str(tmp_path_factory.mktemp("tables")), fixtures(spark, SF)
    for name, rows in {"user_visit_action": t.actions, "user_info": t.users, "product_info": t.products, "city_info": t.cities}.items():
        rows.write.parquet(f"{base}/{name}")
    spark.createDataFrame([(3, TEXT)], "task_id long, task_param string").write.parquet(f"{base}/task")
    return base


def held(df):
    columns = sorted(c for c in df.columns if c != "task_id")
    return sorted(map(repr, (tuple(r) for r in df.select(columns).collect())))


def test_jobs_write_their_results(spark, folder, tmp_path):
    out, t, task = str(tmp_path), fixtures(spark, SF), TaskParams.from_json(TEXT, 3)
    for _ in range(2):  # a job that is run again replaces its results
        written = [name for job in jobs.JOBS for name in jobs.main([job, "--task-id", "3", "--tables", folder, "--out", out])]
    assert len(written) == 8
    sessions = session.filtered_sessions(t.actions, t.users, task)
    actions = session.in_date_range(t.actions, task.start_date, task.end_date)
    top = session.top_categories(session.session_detail(actions, sessions))
    want = {
        "session_aggr_stat": session.session_aggr_stat(sessions),
        "session_random_extract": session.sample_sessions(sessions),
        "top10_category": top,
        "page_split_convert_rate": pageflow.conversion_text(pageflow.conversion_rates(actions, task.target_page_flow)),
        "area_top3_product": product.area_top_products(t.actions, t.cities, t.products, task.start_date, task.end_date, Settings().top_products),
    }
    for name, rows in want.items():
        found = spark.read.parquet(f"{out}/{name}")
        assert held(found) == held(rows) and len(held(found)), name
        assert {r.task_id for r in found.select("task_id").collect()} == {3}


def test_arguments(folder, tmp_path):
    with pytest.raises(TaskNotFound):
        jobs.main(["product", "--task-id", "9", "--tables", folder, "--out", str(tmp_path)])
    with pytest.raises(SystemExit):
        jobs.main(["session", "--out", str(tmp_path)])


def test_ads_program(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1704067200000 p1 c1 1 7\n" * 2 + "1704067200000 p2 c3 3 9\n")
    assert jobs.main(["ads", "--lines", str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--once"]) == []
    stat = jobs.AdStream(spark, str(tmp_path / "out")).stat_totals()
    assert sorted(tuple(r) for r in stat.collect()) == [("2024-01-01", "p1", "c1", 7, 2), ("2024-01-01", "p2", "c3", 9, 1)]


def test_results_and_inputs_in_a_database(spark, folder, tmp_path):
    """Cities and tasks come from a database, results go to it; a job that is run again, or finds nothing, replaces its rows."""
    url, driver = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    db, t = Database(spark, url, {"driver": driver}, text_type="VARCHAR(2000)"), fixtures(spark, SF)
    db.append(t.cities, "city_info")
    db.append(spark.createDataFrame([(3, TEXT), (4, TEXT.replace("2024-01-31", "2023-01-31"))], "task_id long, task_param string"), "task")
    given = ["--tables", folder, "--out", str(tmp_path), "--jdbc", url, "--jdbc-option", f"driver={driver}", "--jdbc-tables", "city_info", "task"]
    for _ in range(2):
        for job in ("product", "pageflow"):
            assert jobs.main([job, "--task-id", "3", *given])
    assert jobs.main(["product", "--task-id", "4", *given]) == ["area_top3_product"]
    want = product.area_top_products(t.actions, t.cities, t.products, "2024-01-01", "2024-01-31", Settings().top_products, 3)
    found = db.read("area_top3_product")
    assert held(found.toDF(*(c.lower() for c in found.columns))) == held(want)
    assert {r[0] for r in found.select("task_id").collect()} == {3}
    assert db.read("page_split_convert_rate").count() == 1
    db.replace_groups(want.limit(0), "area_top3_product", ["task_id"], [(3,)])
    assert db.read("area_top3_product").count() == 0


def test_tables_in_the_catalog(spark, folder, tmp_path):
    """The program for tables lays them out, and jobs read the catalog with the same results."""
    names = ("user_visit_action", "user_info", "product_info", "city_info", "task")
    try:
        jobs.main(["tables", "--tables", folder, "--out", f"{tmp_path}/tables"])
        catalog.save_plain(spark.read.parquet(f"{folder}/task"), "task", f"{tmp_path}/tables/task")
        assert {f.split("date=")[1][:7] for f in spark.table("user_visit_action").inputFiles()} == {"2024-01"}
        for job in ("session", "product"):
            a = jobs.main([job, "--task-id", "3", "--out", f"{tmp_path}/a"])
            assert a == jobs.main([job, "--task-id", "3", "--tables", folder, "--out", f"{tmp_path}/b"])
            for name in a:
                assert held(spark.read.parquet(f"{tmp_path}/a/{name}")) == held(spark.read.parquet(f"{tmp_path}/b/{name}")), name
        assert not [f for f in os.listdir(f"{tmp_path}/a") if f.startswith("_work")]
    finally:
        catalog.drop(spark, *names)


def test_the_log_can_come_from_kafka(spark, tmp_path):
    """No broker here: the program gets as far as asking Spark for the source."""
    with pytest.raises(Exception, match="(?i)kafka"):
        jobs.main(["ads", "--kafka", "localhost:9092", "--topics", "a,b", "--out", str(tmp_path), "--once"])
    for bad in (["ads", "--kafka", "x", "--out", "o"], ["tables", "--out", "o"], ["product", "--task-id", "1", "--out", "o", "--jdbc-tables", "task"]):
        with pytest.raises(SystemExit):
            jobs.main(bad)
