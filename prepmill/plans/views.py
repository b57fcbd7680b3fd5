"""Row views: sort, slices, samples, filters."""

from ..operators import view as V
from ..sources import read_parquet
from .base import query, table, view


@query(
    "v1_sort",
    "select event_id, event_type, value from events_null",
    ("events_null",),
)
def v1(spark, sf):
    nulls = view(spark, sf, "events_null").select("event_id", "event_type", "value")
    return V.sort(nulls, "value", ["event_id"], ascending=False)


@query(
    "v2_head",
    "select event_id, event_type, value from events order by event_id limit 1000",
)
def v2(spark, sf):
    return V.head(table(spark, sf, "events").select("event_id", "event_type", "value"), 1000, ["event_id"])


@query(
    "v3_tail",
    "select event_id, event_type, value from events order by event_id desc limit 1000",
)
def v3(spark, sf):
    return V.tail(table(spark, sf, "events").select("event_id", "event_type", "value"), 1000, ["event_id"])


@query(
    "v4_sample",
    """select event_id, value from events
    order by cast(concat('0x', substr(md5(concat('42', ':', cast(event_id as varchar))),1,15)) as bigint), event_id limit 500""",
)
def v4(spark, sf):
    return V.sample(table(spark, sf, "events").select("event_id", "value"), 500, "event_id")


@query(
    "v5_top_rows",
    """select event_id, event_type, value from events_null
    order by value desc nulls last, event_id limit 100""",
    ("events_null",),
)
def v5(spark, sf):
    rows = view(spark, sf, "events_null").select("event_id", "event_type", "value")
    return V.view(rows, 100, "top", "value", False, ["event_id"])


@query(
    "v5_bottom_rows",
    """select event_id, event_type, value from events_null
    order by value asc nulls first, event_id desc limit 2000""",
    ("events_null",),
)
def v5b(spark, sf):
    rows = view(spark, sf, "events_null").select("event_id", "event_type", "value")
    return V.view(rows, 2000, "bottom", "value", False, ["event_id"])


@query("v6_select", "select l_orderkey, l_quantity from lineitem")
def v6(spark, sf):
    return V.select(table(spark, sf, "lineitem"), ["l_orderkey", "l_quantity"])


@query(
    "v7_compare_constant",
    "select l_orderkey, l_linenumber, l_quantity, l_extendedprice from lineitem where l_quantity >= 30",
)
def v7(spark, sf):
    line = read_parquet(spark, f"{sf}/lineitem.parquet", where=("l_quantity", ">=", "30"))
    return line.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query(
    "v7_compare_columns",
    "select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem where l_partkey < l_suppkey",
)
def v7b(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return V.matching_rows(line, "l_partkey", "<", other="l_suppkey")


@query(
    "v7_not_equal_missing",
    "select event_id, event_type from events_null where event_type is null or event_type <> 'click'",
    ("events_null",),
)
def v7c(spark, sf):
    rows = view(spark, sf, "events_null").select("event_id", "event_type")
    return V.matching_rows(rows, "event_type", "!=", "click")
