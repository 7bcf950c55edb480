import pytest

from clickloom.operators import ads, pageflow, product, session, skew
from clickloom.params import TaskParams
from clickloom.sources.tables import ACTION_SCHEMA


def action(session_id, time, date="2024-01-01", user=1, page=1, keyword=None, click=None, prod=None, orders=None, pays=None, city=1):
    return (date, user, session_id, page, f"{date} {time}", keyword, click, prod, orders, None, pays, None, city)


@pytest.fixture
def actions(spark):
    rows = [
        action("a", "08:00:00", page=1, keyword="kw1"),
        action("a", "08:00:03", page=2, click=12, prod=5),
        action("a", "08:00:09", page=3, click=1, prod=6),
        action("b", "09:00:00", user=2, page=1, orders="1,12"),
        action("b", "09:00:02", user=2, page=2, pays="1"),
        action("c", "08:30:00", user=9, page=1, orders="", date="2024-01-02"),
        action("d", "8:15:00", user=2, page=2, click=12, prod=5, date="2024-01-02"),
    ]
    return spark.createDataFrame(rows, ACTION_SCHEMA)


@pytest.fixture
def users(spark):
    rows = [(1, "u1", "n1", 20, "p1", "c1", "male"), (2, "u2", "n2", None, "p2", "c2", "female")]
    return spark.createDataFrame(rows, "user_id long, username string, name string, age int, professional string, city string, sex string")


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_session_aggregates(actions):
    got = {r.session_id: r for r in session.session_aggregates(actions).collect()}
    assert (got["a"].visit_length, got["a"].step_length, got["a"].click_category_ids, got["a"].search_keywords) == (9, 3, "1,12", "kw1")
    assert (got["c"].visit_length, got["c"].click_category_ids) == (0, "") and got["d"].start_time == "2024-01-02 08:15:00"


def test_filters(actions, users):
    def ids(**params):
        return {r.session_id for r in session.filtered_sessions(actions, users, TaskParams(**params)).collect()}

    assert ids() == {"a", "b", "d"}  # the user of c is unknown
    assert ids(start_age=10, end_age=30) == {"a"}  # missing data rejects
    assert ids(start_age=10) == {"a", "b", "d"}  # one end is no range
    assert ids(cities=("c2", "zz")) == {"b", "d"} and ids(sex="male") == {"a"} and ids(professionals=("p1",)) == {"a"}
    assert ids(keywords=("kw1",)) == {"a"} and ids(category_ids=(1,)) == {"a"} and ids(category_ids=(2,)) == set()
    assert ids(start_date="2024-01-02", end_date="2024-01-02") == {"d"}


def test_histogram_and_ratios(spark, actions, users):
    sessions = session.session_aggregates(actions)
    h = session.session_histogram(sessions).first()
    assert (h.session_count, h.visit_length_7s_9s, h.visit_length_1s_3s, h.step_length_1_3) == (4, 1, 1, 4)
    assert sum(h[b] for b in session.VISIT_BINS) == 2  # visits of 0 seconds are in no bin
    assert session.session_aggr_stat(sessions).first().visit_length_7s_9s_ratio == 0.25
    assert session.session_aggr_stat(sessions.where("false")).first().step_length_1_3_ratio is None


def test_counts_and_tops(actions):
    assert rows(session.category_counts(actions), "category_id") == [(1, 1, 1, 1), (12, 2, 1, 0)]
    top = session.top_categories(actions, 1)
    assert rows(top) == [(0, 12, 2, 1, 0)]
    assert rows(session.top_category_sessions(actions, top, 1)) == [(0, 12, "a", 1)]  # equal clicks: smaller id
    assert rows(session.distinct_categories(actions), "category_id") == [(1,), (12,)]


def test_detail_once_and_nulls_kept(actions, spark):
    twice = spark.createDataFrame([("a",), ("a",)], "session_id string")
    detail = session.detail_of(actions, twice)
    assert detail.count() == 3 and detail.where("click_category_id is null").count() == 1


def test_sample_quotas(spark):
    data = [(f"s{k}", f"2024-01-0{1 + k % 2} {k % 3:02d}:00:00", "", "") for k in range(60)]
    sessions = spark.createDataFrame(data, "session_id string, start_time string, search_keywords string, click_category_ids string")
    quotas = session.sample_quotas(sessions, 20).collect()
    assert all(q.quota == 3 for q in quotas) and len(quotas) == 6  # 20 / 2 days = 10, a third of it each hour
    drawn = session.sample_sessions(sessions, 20)
    assert drawn.count() == 18 and rows(drawn, "session_id") == rows(session.sample_sessions(sessions, 20), "session_id")
    assert session.sample_sessions(sessions.where("false")).count() == 0


def test_page_flow(actions):
    flow = (1, 2, 3, 4)
    assert rows(pageflow.slice_counts(actions, flow), "page_split") == [("1_2", 2), ("2_3", 1)]
    assert pageflow.start_page_pv(actions, flow).first().pv == 3
    rates = rows(pageflow.conversion_rates(actions, flow), "step")
    assert rates == [(1, "1_2", 2, 3, 0.67), (2, "2_3", 1, 2, 0.5), (3, "3_4", 0, 1, 0.0)]
    none = rows(pageflow.conversion_rates(actions, (8, 9, 1)), "step")
    assert none == [(1, "8_9", 0, 0, None), (2, "9_1", 0, 0, None)]
    assert pageflow.conversion_text(pageflow.conversion_rates(actions, flow)).first().convert_rate == "1_2=0.67|2_3=0.5|3_4=0.0"
    assert pageflow.conversion_rates(actions, (1,)).count() == 0


def test_area_top_products(spark, actions):
    cities = spark.createDataFrame([("1", "c1", "华北"), ("7", "c7", "华南")], "city_id string, city_name string, area string")
    products = spark.createDataFrame([(5, "five", '{"product_status": 0}'), (6, "six", "?")], "product_id long, product_name string, extend_info string")
    got = rows(product.area_top_products(actions, cities, products, "2024-01-01", "2024-01-02", n=2), "product_id")
    assert got == [(0, "华北", "A级", 5, "1:c1", 2, "five", "自营商品"), (0, "华北", "A级", 6, "1:c1", 1, "six", "第三方商品")]
    one = product.area_top_products(actions, cities, products.where("product_id = 6"), n=1)
    assert [r.product_id for r in one.collect()] == [6]  # a product without a record takes no rank
    assert product.product_clicks(actions, "2024-01-02", "2024-01-02").count() == 1  # the end day counts
    assert product.clicks_with_cities(product.product_clicks(actions, None, None), cities).count() == 3


@pytest.fixture
def clicks(spark):
    lines = [("1704067200000 p1 c1 1 7",)] * 3 + [("1704067260000 p1 c2 2 8",), ("1704067260000 p1 c2 2 9",), ("bad",), ("x p c 1 2",), (None,), ("",)]
    return ads.parse_log(spark.createDataFrame(lines, "value string"))


def test_ads(spark, clicks):
    assert clicks.count() == 5
    counts = ads.user_click_counts(clicks)
    assert rows(counts, "user_id", "ad_id") == [("2024-01-01", 1, 7, 3), ("2024-01-01", 2, 8, 1), ("2024-01-01", 2, 9, 1)]
    listed = ads.blacklisted_users(counts, 3)
    assert rows(listed) == [(1,)]
    assert ads.without_blacklisted(clicks, listed).count() == 2
    stat = ads.click_stat(clicks)
    assert rows(ads.province_top(stat, 2), "ad_id") == [("2024-01-01", "p1", 7, 3), ("2024-01-01", "p1", 8, 1)]  # ties: smaller ad
    assert rows(ads.click_trend(clicks), "minute", "ad_id")[0] == ("2024-01-01", "00", "00", 7, 3)


def test_skew_joins_lose_nothing(spark):
    left = spark.createDataFrame([(k % 3 and 1, k) for k in range(60)] + [(None, 99)], "key long, x long")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "key long, y string")
    plain = rows(left.join(right, "key").select("key", "x", "y"), "x")
    hot = [r.key for r in skew.hot_keys(left, "key", fraction=1.0).collect()]
    assert hot == [1]
    for joined in (skew.salted_join(left, right, "key", 7), skew.split_join(left, right, "key", hot, 5), skew.broadcast_join(left, right, "key"), skew.broadcast_join(left, right, "key", 1)):
        assert rows(joined.select("key", "x", "y"), "x") == plain
    assert rows(skew.two_stage_count(left.where("key is not null"), "key"), "key") == [(0, 20), (1, 40)]
