"""Missing values, duplicates, outliers, column cleaning, conditional changes."""

from pyspark.sql import functions as F

from ..operators import cleaning as K
from ..operators import duplicates as D
from ..operators import missing as M
from ..operators import outliers as O
from .base import query, rounded, table, view


def _nulls(spark, sf):
    return view(spark, sf, "events_null").select("event_id", "event_type", "value")


@query("m1_drop_missing", "select event_id, event_type, value from events_null where value is not null", ("events_null",))
def m1(spark, sf):
    return M.drop_missing(_nulls(spark, sf), "value")


@query(
    "m2_impute_mean",
    """select event_id, event_type, round(coalesce(value, (select avg(value) from events_null)), 6) as value
    from events_null""",
    ("events_null",),
)
def m2(spark, sf):
    return rounded(M.impute_mean(_nulls(spark, sf), "value"))


@query(
    "m3_impute_median",
    """select event_id, event_type, round(coalesce(value, (select quantile_cont(value, 0.5) from events_null)), 6) as value
    from events_null""",
    ("events_null",),
)
def m3(spark, sf):
    return rounded(M.impute_median(_nulls(spark, sf), "value"))


@query(
    "m4_impute_mode",
    """select event_id, coalesce(event_type, (select event_type from events_null where event_type is not null
      group by event_type order by count(*) desc, event_type limit 1)) as event_type, value from events_null""",
    ("events_null",),
)
def m4(spark, sf):
    return M.impute_mode(_nulls(spark, sf), "event_type")


def _fill_sql(order: str) -> str:
    return (
        f"select event_id, last_value(v ignore nulls) over (order by event_id {order} "
        "rows between unbounded preceding and current row) as v from events_gap"
    )


@query("m5_forward_fill", _fill_sql("asc"), ("events_gap",))
def m5(spark, sf):
    return M.forward_fill(view(spark, sf, "events_gap"), "v", "event_id")


@query("m6_backward_fill", _fill_sql("desc"), ("events_gap",))
def m6(spark, sf):
    return M.backward_fill(view(spark, sf, "events_gap"), "v", "event_id")


@query(
    "m5_forward_fill_text",
    """select event_id, ts, last_value(event_type ignore nulls) over (order by ts
      rows between unbounded preceding and current row) as event_type from events_null""",
    ("events_null",),
)
def m5b(spark, sf):
    rows = view(spark, sf, "events_null").select("event_id", "ts", "event_type")
    return M.forward_fill(rows, "event_type", "ts")


@query("m7_impute_constant", "select event_id, coalesce(event_type, 'none') as event_type, value from events_null",
       ("events_null",))
def m7(spark, sf):
    return M.impute_constant(_nulls(spark, sf), "event_type", "none")


KEYS = "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice"


@query(
    "d1_duplicate_rows",
    f"select * from part_dup where p_partkey in (select p_partkey from part_dup group by {KEYS} having count(*) > 1)",
    ("part_dup",),
)
def d1(spark, sf):
    return D.duplicate_rows(view(spark, sf, "part_dup"), ["branch"])


@query(
    "d1_duplicate_rows_no_key",
    """select p_brand, p_type, p_size from (select *, count(*) over (partition by p_brand, p_type, p_size) as n from part)
    where n > 1""",
)
def d1b(spark, sf):
    return D.duplicate_rows(table(spark, sf, "part").select("p_brand", "p_type", "p_size"))


@query(
    "d2_duplicate_groups",
    f"select {KEYS}, count(*) as copies from part_dup group by {KEYS} having count(*) > 1", ("part_dup",))
def d2(spark, sf):
    return D.duplicate_groups(view(spark, sf, "part_dup"), ["branch"])


@query(
    "d2_duplicate_documents",
    "select text, lang, count(*) as copies from documents group by text, lang having count(*) > 1",
)
def d2b(spark, sf):
    return D.duplicate_groups(table(spark, sf, "documents").select("text", "lang"))


@query(
    "d3_remove_all",
    f"select {KEYS}, min(branch) as branch from part_dup group by {KEYS} having count(*) = 1", ("part_dup",))
def d3(spark, sf):
    return D.remove_all(view(spark, sf, "part_dup"), ["branch"])


@query("d4_keep_first", f"select {KEYS}, min(branch) as branch from part_dup group by {KEYS}", ("part_dup",))
def d4(spark, sf):
    return D.keep_first(view(spark, sf, "part_dup"), ["branch"])


@query("d5_keep_last", f"select {KEYS}, max(branch) as branch from part_dup group by {KEYS}", ("part_dup",))
def d5(spark, sf):
    return D.keep_last(view(spark, sf, "part_dup"), ["branch"])


@query(
    "d6_mark",
    f"select *, count(*) over (partition by {KEYS}) > 1 as is_duplicate from part_dup", ("part_dup",))
def d6(spark, sf):
    return D.mark(view(spark, sf, "part_dup"), ["branch"])


@query(
    "d6_mark_documents",
    "select doc_id, text, lang, count(*) over (partition by text, lang) > 1 as is_duplicate from documents",
)
def d6b(spark, sf):
    return D.mark(table(spark, sf, "documents").select("doc_id", "text", "lang"), ["doc_id"])


FENCES = """b as (select q1 - 1.5*(q3-q1) as lo, q3 + 1.5*(q3-q1) as hi from
 (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events_null))"""


@query(
    "o1_remove_outliers",
    f"with {FENCES} select event_id, event_type, value from events_null, b where value >= lo and value <= hi",
    ("events_null",))
def o1(spark, sf):
    return O.remove_outliers(_nulls(spark, sf), "value")


@query(
    "o2_cap_outliers",
    f"""with {FENCES} select event_id, event_type, round(case when value is not null
    then greatest(least(value, hi), lo) end, 6) as value from events_null, b""",
    ("events_null",))
def o2(spark, sf):
    return rounded(O.cap_outliers(_nulls(spark, sf), "value"))


@query(
    "o3_winsorize",
    """with s as (select value, row_number() over (order by value) - 1 as i, count(*) over () as n
      from events_null where value is not null),
    b as (select max(case when i = floor(0.05*n) then value end) as lo,
                 max(case when i = n - floor(0.05*n) - 1 then value end) as hi from s)
    select event_id, event_type, case when value is not null then greatest(least(value, hi), lo) end as value
    from events_null, b""",
    ("events_null",))
def o3(spark, sf):
    return O.winsorize(_nulls(spark, sf), "value")


LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query("cl1_drop_constant", f"select {LINE}, q2 from line_clean", ("line_clean",))
def cl1(spark, sf):
    return K.drop_constant(view(spark, sf, "line_clean"))


@query("cl2_drop_correlated", f"select {LINE}, konst from line_clean", ("line_clean",))
def cl2(spark, sf):
    return K.drop_correlated(view(spark, sf, "line_clean"))


@query(
    "co1_remove_where",
    "select event_id, event_type, value from events_null where value is null or not (value > 100)", ("events_null",))
def co1(spark, sf):
    return K.remove_where(_nulls(spark, sf), "value", ">", "100")


@query(
    "co1_remove_not_equal",
    "select event_id, event_type, value from events_null where event_type = 'view'", ("events_null",))
def co1b(spark, sf):
    return K.remove_where(_nulls(spark, sf), "event_type", "!=", "view")


@query(
    "co2_replace_where",
    "select event_id, event_type, case when value <= 5 then 5.0 else value end as value from events_null",
    ("events_null",))
def co2(spark, sf):
    return K.replace_where(_nulls(spark, sf), "value", "<=", 5.0, 5)


@query(
    "co2_replace_text",
    "select event_id, case when event_type is null or event_type <> 'click' then 'other' else event_type end as event_type, value from events_null",
    ("events_null",))
def co2b(spark, sf):
    return K.replace_where(_nulls(spark, sf), "event_type", "!=", "other", "click")
