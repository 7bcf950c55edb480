"""Column functions of the clickstream jobs. No Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Area levels and product status names as the reports print them.
AREA_LEVELS = {
    "华北": "A级",
    "华东": "A级",
    "华南": "B级",
    "华中": "B级",
    "西北": "C级",
    "西南": "C级",
}
OTHER_LEVEL = "D级"
OWN_PRODUCT = "自营商品"
THIRD_PARTY_PRODUCT = "第三方商品"


def is_empty(c: Column) -> Column:
    """Null or ''."""
    return c.isNull() | (c == "")


def is_not_empty(c: Column) -> Column:
    return ~is_empty(c)


def trim_comma(c: Column) -> Column:
    """Without one comma at each end."""
    return F.regexp_replace(c, "^,|,$", "")


def two_digits(c: Column) -> Column:
    """Text of two characters as it is, any other with one '0' before it (longer text too: this is no padding)."""
    return F.when(F.length(c) == 2, c).otherwise(F.concat(F.lit("0"), c))


def concat_field(c: Column, separator: str, name: str) -> Column:
    """Value of name in 'k=v|k=v'; a part counts only with exactly one '=' and a value."""
    parts = F.transform(F.split(c, _literal(separator)), lambda p: F.split(p, "="))
    found = F.filter(parts, lambda p: (F.size(p) == 2) & (F.get(p, F.lit(0)) == name) & (F.get(p, F.lit(1)) != ""))
    return F.get(F.get(found, F.lit(0)), F.lit(1))


def set_concat_field(c: Column, separator: str, name: str, value: Column) -> Column:
    """The record with the value of name replaced; other parts stay as they are."""
    parts = F.transform(
        F.split(c, _literal(separator)), lambda p: F.when(F.split(p, "=")[0] == name, F.concat(F.lit(f"{name}="), value)).otherwise(p)
    )
    return F.array_join(parts, separator)


def _literal(text: str) -> str:
    return "".join("\\" + x if x in r"\.[]{}()*+-?^$|" else x for x in text)


def as_time(c: Column) -> Column:
    """Timestamp of 'yyyy-MM-dd HH:mm:ss' text (hours of one digit too); null if it is none."""
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd H:mm:ss"))


def before(a: Column, b: Column) -> Column:
    """Is time text a before b? False if either cannot be read."""
    return F.coalesce(as_time(a) < as_time(b), F.lit(False))


def after(a: Column, b: Column) -> Column:
    return F.coalesce(as_time(a) > as_time(b), F.lit(False))


def minus_seconds(a: Column, b: Column) -> Column:
    """Whole seconds from b to a."""
    return F.unix_timestamp(as_time(a)) - F.unix_timestamp(as_time(b))


def date_hour(c: Column) -> Column:
    """'yyyy-MM-dd_HH' of a time text."""
    return F.date_format(as_time(c), "yyyy-MM-dd_HH")


def format_date(c: Column) -> Column:
    """'yyyy-MM-dd' of a date or timestamp."""
    return F.date_format(c, "yyyy-MM-dd")


def format_time(c: Column) -> Column:
    """'yyyy-MM-dd HH:mm:ss' of a timestamp."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def date_key(c: Column) -> Column:
    """'yyyyMMdd' of a date or timestamp."""
    return F.date_format(c, "yyyyMMdd")


def parse_date_key(c: Column) -> Column:
    return F.try_to_date(c, "yyyyMMdd")


def minute_key(c: Column) -> Column:
    """'yyyyMMddHHmm' of a timestamp."""
    return F.date_format(c, "yyyyMMddHHmm")


def split_minute_key(c: Column) -> tuple[Column, Column, Column]:
    """Date 'yyyy-MM-dd', hour 'HH' and minute 'mm' of a minute key."""
    date = F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2))
    return date, F.substring(c, 9, 2), F.substring(c, 11, 2)


def yesterday() -> Column:
    return F.date_format(F.date_sub(F.current_date(), 1), "yyyy-MM-dd")


def today() -> Column:
    return F.date_format(F.current_date(), "yyyy-MM-dd")


def from_millis(c: Column) -> Column:
    """Timestamp of epoch milliseconds given as text; days follow spark.sql.session.timeZone."""
    return F.timestamp_millis(c.try_cast("long"))


def round_half_up(c: Column, digits: int = 2) -> Column:
    """Half up, by floor(x * 10^n + 0.5) / 10^n: the same in every engine. Ratios beside it stay exact."""
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null if b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def concat_long_string(number: Column, text: Column, separator: str) -> Column:
    """number, separator and text joined; nulls read 'null'."""
    return F.concat(F.coalesce(number.cast("string"), F.lit("null")), F.lit(separator), F.coalesce(text, F.lit("null")))


def json_field(c: Column, name: str) -> Column:
    """A top-level field of a JSON text; null where the text cannot be read."""
    return F.get_json_object(c, f"$.{name}")


def json_array_item(c: Column, index: int, name: str) -> Column:
    """A field of one object of a JSON array; single-quoted JSON is read too. Null where the text cannot be read."""
    items = F.from_json(c, "array<map<string,string>>", {"allowSingleQuotes": "true"})
    return F.get(items, F.lit(index))[name]


def group_concat_distinct(c: Column, separator: str = ",") -> Column:
    """Aggregate: the distinct values, sorted and joined."""
    return F.array_join(F.array_sort(F.collect_set(c)), separator)


def joined_ids(c: Column) -> Column:
    """Aggregate: the distinct numbers, in order, joined by commas; '' if there are none."""
    return F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda x: x.cast("string")), ",")


def area_level(area: Column) -> Column:
    """Level of a sales area; unknown and null areas have the last level."""
    level = None
    for name, value in AREA_LEVELS.items():
        level = F.when(area == name, value) if level is None else level.when(area == name, value)
    return level.otherwise(OTHER_LEVEL)


def product_status(extend_info: Column) -> Column:
    """Own product if product_status is 0; anything else, unreadable JSON included, is third-party."""
    return F.when(json_field(extend_info, "product_status") == "0", OWN_PRODUCT).otherwise(THIRD_PARTY_PRODUCT)


def csv_items(c: Column) -> Column:
    """The items of a comma-joined text as an array, without empty ones."""
    return F.filter(F.split(c, ","), lambda x: x != "")


def page_slices(flow: tuple[int, ...]) -> list[str]:
    """'a_b' for each step of a page path."""
    return [f"{a}_{b}" for a, b in zip(flow, flow[1:])]
