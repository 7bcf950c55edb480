from pyspark.sql import Window
from pyspark.sql import functions as F

from clickloom.functions import columns as C


def one(spark, **exprs):
    return spark.range(1).select(*(e.alias(n) for n, e in exprs.items())).first().asDict()


def test_text_functions(spark):
    lit = F.lit
    got = one(
        spark,
        a=C.trim_comma(lit(",,x,")),
        b=C.two_digits(lit("7")),
        c=C.two_digits(lit("123")),
        d=C.concat_field(lit("a=1|b=|c=1=2|d=4"), "|", "d"),
        e=C.concat_field(lit("a=1|b="), "|", "b"),
        f=C.concat_field(lit("c=1=2"), "|", "c"),
        g=C.set_concat_field(lit("a=1|b=2"), "|", "b", lit("9")),
        h=C.is_empty(lit("")),
        i=C.is_not_empty(F.lit(None).cast("string")),
        j=C.concat_long_string(lit(None).cast("long"), lit("x"), ":"),
    )
    assert got == {"a": ",x", "b": "07", "c": "0123", "d": "4", "e": None, "f": None, "g": "a=1|b=9", "h": True, "i": False, "j": "null:x"}


def test_time_functions(spark):
    lit = F.lit
    t = C.as_time(lit("2024-01-02 3:04:05"))
    date, hour, minute = C.split_minute_key(C.minute_key(t))
    got = one(
        spark,
        a=C.before(lit("2024-01-01 00:00:00"), lit("2024-01-02 00:00:00")),
        b=C.after(lit("bad"), lit("2024-01-02 00:00:00")),
        c=C.minus_seconds(lit("2024-01-01 00:01:00"), lit("2024-01-01 00:00:01")),
        d=C.date_hour(lit("2024-01-02 03:04:05")),
        e=C.date_key(t),
        f=date,
        g=hour,
        h=minute,
        i=F.date_format(C.parse_date_key(lit("20240102")), "yyyy-MM-dd"),
        j=C.parse_date_key(lit("x")),
        k=F.date_format(C.from_millis(lit("1704164645000")), "yyyy-MM-dd HH:mm:ss"),
    )
    assert got == {"a": True, "b": False, "c": 59, "d": "2024-01-02_03", "e": "20240102", "f": "2024-01-02", "g": "03", "h": "04", "i": "2024-01-02", "j": None, "k": "2024-01-02 03:04:05"}


def test_rounding_is_half_up_on_the_double(spark):
    assert one(spark, a=C.round_half_up(C.ratio(F.lit(57), F.lit(200))), b=C.ratio(F.lit(1), F.lit(0)))["b"] is None
    assert one(spark, a=C.round_half_up(C.ratio(F.lit(1), F.lit(8))))["a"] == 0.13


def test_levels_and_status(spark):
    rows = spark.createDataFrame([("华北", '{"product_status": 0}'), ("华中", '{"product_status": 1}'), ("西南", "no json"), ("东北", None), (None, "{}")], "area string, info string")
    got = [tuple(r) for r in rows.select(C.area_level(F.col("area")), C.product_status(F.col("info"))).collect()]
    assert got == [("A级", "自营商品"), ("B级", "第三方商品"), ("C级", "第三方商品"), ("D级", "第三方商品"), ("D级", "第三方商品")]


def test_distinct_sets_are_exact_and_sorted(spark):
    rows = spark.createDataFrame([(12, "b"), (1, "a"), (12, "b"), (None, None)], "id long, s string")
    assert tuple(rows.agg(C.joined_ids(F.col("id")), C.group_concat_distinct(F.col("s"))).first()) == ("1,12", "a,b")


def test_json_and_slices(spark):
    assert one(spark, a=C.json_field(F.lit('{"x": 3}'), "x"), b=C.json_field(F.lit("?"), "x")) == {"a": "3", "b": None}
    quoted = F.lit("[{'name': 'a', 'score': 80}, {'name': 'b', 'score': 90}]")
    assert one(spark, a=C.json_array_item(quoted, 1, "score"), b=C.json_array_item(quoted, 5, "score"), c=C.json_array_item(F.lit("?"), 0, "x")) == {"a": "90", "b": None, "c": None}
    t = C.as_time(F.lit("2024-01-02 03:04:05"))
    assert one(spark, a=C.format_date(t), b=C.format_time(t)) == {"a": "2024-01-02", "b": "2024-01-02 03:04:05"}
    days = one(spark, a=F.datediff(C.today().cast("date"), C.yesterday().cast("date")))
    assert days == {"a": 1}
    assert C.page_slices((1, 2, 3)) == ["1_2", "2_3"] and C.page_slices((1,)) == []


def test_grades_with_known_answers(spark):
    """Searched CASE, IF and row_number."""
    rows = spark.createDataFrame([(85,), (90,), (60,), (73,)], "grade int")
    g = F.col("grade")
    level = F.when(g >= 90, "A").when(g >= 80, "B").when(g >= 70, "C").otherwise("D")
    got = {r.grade: (r.level, r.verdict) for r in rows.select("grade", level.alias("level"), F.when(g >= 80, "GOOD").otherwise("BAD").alias("verdict")).collect()}
    assert got == {85: ("B", "GOOD"), 90: ("A", "GOOD"), 60: ("D", "BAD"), 73: ("C", "BAD")}
    ranked = spark.createDataFrame([("class1", 80), ("class1", 75), ("class1", 90), ("class1", 60)], "class string, grade int")
    rank = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("grade")))
    assert {r.grade: r.rank for r in ranked.select("grade", rank.alias("rank")).collect()} == {80: 2, 75: 3, 90: 1, 60: 4}
