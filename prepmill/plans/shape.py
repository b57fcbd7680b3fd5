"""Reshape and column queries."""

from pyspark.sql import functions as F

from ..operators import columns as C
from ..operators import reshape as R
from .base import query, rounded, table, view

FUNCTIONS = {"sum": "sum", "mean": "avg", "count": "count", "min": "min", "max": "max", "std": "stddev_samp"}


def _pivot_sql(fn: str) -> str:
    cell = "coalesce(round({f}(l_quantity) filter (where l_linestatus = '{s}'), 6), 0)"
    if fn == "count":
        cell = "{f}(l_quantity) filter (where l_linestatus = '{s}')"
    f = FUNCTIONS[fn]
    return (
        f"""select l_returnflag, {cell.format(f=f, s='F')} as "F", {cell.format(f=f, s='O')} as "O"
        from lineitem group by l_returnflag"""
    )


def _register_pivot(fn: str) -> None:
    @query(f"rs1_pivot_{fn}", _pivot_sql(fn))
    def run(spark, sf):
        return rounded(R.pivot(table(spark, sf, "lineitem"), ["l_returnflag"], "l_linestatus", "l_quantity", fn))


for _fn in FUNCTIONS:
    _register_pivot(_fn)


@query(
    "rs1_pivot_nulls",
    """
select user_id, coalesce(round(sum(value) filter (where event_type='click'),6),0) as click,
 coalesce(round(sum(value) filter (where event_type='error'),6),0) as error,
 coalesce(round(sum(value) filter (where event_type='purchase'),6),0) as purchase,
 coalesce(round(sum(value) filter (where event_type='signup'),6),0) as signup,
 coalesce(round(sum(value) filter (where event_type='view'),6),0) as "view"
from (select user_id, event_type, value from events_null where event_type is not null and user_id is not null)
group by user_id""",
    ("events_null",),
)
def rs1n(spark, sf):
    wide = R.pivot(view(spark, sf, "events_null"), ["user_id"], "event_type", "value", "sum")
    return rounded(wide)


@query(
    "rs2_unpivot",
    """
select c_custkey, 'c_name' as variable, c_name as "value" from customer
union all select c_custkey, 'c_nationkey', cast(c_nationkey as varchar) from customer
union all select c_custkey, 'c_mktsegment', c_mktsegment from customer""",
)
def rs2(spark, sf):
    return R.unpivot(table(spark, sf, "customer"), ["c_custkey"], ["c_name", "c_nationkey", "c_mktsegment"])


@query(
    "rs2_unpivot_wide",
    """
select l_returnflag, l_linestatus as status, round(avg(l_quantity),6) as avg_qty
from lineitem group by l_returnflag, l_linestatus""",
)
def rs2b(spark, sf):
    wide = R.pivot(table(spark, sf, "lineitem"), ["l_returnflag"], "l_linestatus", "l_quantity", "mean", fill=None)
    return rounded(R.unpivot(wide, ["l_returnflag"], var_name="status", value_name="avg_qty"))


@query("c1_drop", "select event_id, ts, user_id, event_type from events")
def c1(spark, sf):
    return C.drop(table(spark, sf, "events"), ["value", "props"])


@query("c2_rename", "select event_id, user_id as customer_id, value from events")
def c2(spark, sf):
    return C.rename(table(spark, sf, "events").select("event_id", "user_id", "value"), "user_id", "customer_id")


@query(
    "c3_to_datetime",
    """select o_orderkey, case when o_orderkey % 3 <> 0 then o_orderdate end as t from orders""",
)
def c3(spark, sf):
    orders = table(spark, sf, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.lit("not a date")).otherwise(F.col("o_orderdate").cast("string"))
    return C.to_datetime(orders.select("o_orderkey", text.alias("t")), "t")


@query(
    "c4_to_integer",
    """select event_id, case when try_cast(t as double) = floor(try_cast(t as double))
       then cast(try_cast(t as double) as bigint) end as t from text_num""",
    ("text_num",),
)
def c4(spark, sf):
    return C.to_integer(view(spark, sf, "text_num").select("event_id", "t"), "t")


@query("c5_to_float", "select event_id, try_cast(t as double) as t from text_num", ("text_num",))
def c5(spark, sf):
    return C.to_float(view(spark, sf, "text_num").select("event_id", "t"), "t")


@query(
    "c6_to_category",
    """select event_id, event_type, coalesce(code, -1) as event_type_code from events_null
    left join (select event_type as k, dense_rank() over (order by event_type) - 1 as code
               from (select distinct event_type from events_null where event_type is not null)) on k = event_type""",
    ("events_null",),
)
def c6(spark, sf):
    return C.to_category(view(spark, sf, "events_null").select("event_id", "event_type"), "event_type")


@query(
    "c6_to_category_many_values",
    """select c_custkey, code as c_name_code from customer
    join (select c_name as k, dense_rank() over (order by c_name) - 1 as code from (select distinct c_name from customer))
      on k = c_name""",
)
def c6b(spark, sf):
    return C.to_category(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_name").drop("c_name")


@query("c7_to_boolean", "select event_id, user_id <> 0 as user_id, event_type <> '' as event_type from events_null",
       ("events_null",))
def c7(spark, sf):
    rows = view(spark, sf, "events_null").select("event_id", "user_id", "event_type")
    return C.to_boolean(C.to_boolean(rows, "user_id"), "event_type")


@query(
    "c7_to_boolean_truthy",
    "select event_id, coalesce(event_type <> '', true) as event_type from events_null", ("events_null",))
def c7b(spark, sf):
    rows = view(spark, sf, "events_null").select("event_id", "event_type")
    return C.to_boolean(rows, "event_type", mode="truthy")


@query("c8_to_text", "select event_id, cast(user_id as varchar) as user_id from events")
def c8(spark, sf):
    return C.to_text(table(spark, sf, "events").select("event_id", "user_id"), "user_id")


@query("x1_merge_columns", "select p_partkey, concat_ws(' / ', p_brand, p_type) as kind from part")
def x1(spark, sf):
    return C.merge(table(spark, sf, "part"), ["p_brand", "p_type"], "kind", " / ").select("p_partkey", "kind")


@query(
    "x2_split_column",
    "select p_partkey, split_part(p_brand, '#', 1) as word, split_part(p_brand, '#', 2) as number from part",
)
def x2(spark, sf):
    return C.split(table(spark, sf, "part"), "p_brand", "#", ["word", "number"]).select("p_partkey", "word", "number")
