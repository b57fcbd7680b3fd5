"""Advice-table queries."""

from ..operators import advice as A
from .base import query, rounded, table, view
from .charts import LINE_NUMBERS, pairs_sql


@query(
    "ad1_insight_overview",
    """select count(*) as n_rows, 5 as n_columns, 3 as n_numeric, 1 as n_categorical,
    'event_id, user_id, value' as numeric_columns, 'event_type' as categorical_columns,
    concat_ws(', ', case when count(event_type) < count(*) then 'event_type' end,
      case when count(value) < count(*) then 'value' end) as missing_columns from events_null""",
    ("events_null",))
def ad1(spark, sf):
    return A.insight_overview(view(spark, sf, "events_null"))


@query(
    "ad2_missing_advice",
    """
with g as (select 0 as pos, 'event_id' as c, count(*) - count(event_id) as m, count(*) as n from events_null
 union all select 3, 'event_type', count(*) - count(event_type), count(*) from events_null
 union all select 4, 'value', count(*) - count(value), count(*) from events_null),
 k as (select *, m*100.0/n as pct, row_number() over (order by m desc, pos) as place,
   row_number() over (order by pos) as nth from g where m > 0)
select c as "column", m as missing, round(pct, 6) as missing_pct, cast(place as int) as place,
 case when nth > 3 then '' when pct > 50 then 'drop column' when pct > 20 then 'advanced imputation'
  else 'simple imputation' end as advice from k where place <= 5 or nth <= 3""",
    ("events_null",))
def ad2(spark, sf):
    return rounded(A.missing_advice(view(spark, sf, "events_null")))


@query(
    "ad3_strong_pairs",
    pairs_sql("line_clean", [*LINE_NUMBERS, "q2"]).replace("select 'l_orderkey' as col_a, 'l_partkey'", "select * from (select 'l_orderkey' as col_a, 'l_partkey'", 1)
    + ") where abs(r) > 0.7 order by abs(r) desc, col_a, col_b limit 5",
    ("line_clean",))
def ad3(spark, sf):
    return rounded(A.strong_pairs(view(spark, sf, "line_clean").drop("konst")))


@query(
    "ad4_quality_assessment",
    """
with u as (select * exclude (branch) from part_dup),
 d as (select (select count(*) from u) - (select count(*) from (select distinct * from u)) as dup, (select count(*) from u) as n),
 h as (select (case when count(distinct p_name) > 0.8*count(*) then 1 else 0 end)
  + (case when count(distinct p_brand) > 0.8*count(*) then 1 else 0 end)
  + (case when count(distinct p_type) > 0.8*count(*) then 1 else 0 end) as k from u)
select * from (
 select 'duplicate_rows' as issue, dup as n, round(dup*100.0/n, 6) as pct from d
 union all select 'high_cardinality_columns', cast(k as bigint), null from h) where n > 0""",
    ("part_dup",))
def ad4(spark, sf):
    return rounded(A.quality_assessment(view(spark, sf, "part_dup").drop("branch")))


@query(
    "ad4_quality_assessment_nulls",
    """select 'missing_columns' as issue, (case when count(event_type) < count(*) then 1 else 0 end)
     + (case when count(value) < count(*) then 1 else 0 end) + cast(0 as bigint) as n, cast(null as double) as pct from events_null""",
    ("events_null",))
def ad4b(spark, sf):
    return rounded(A.quality_assessment(view(spark, sf, "events_null")))


@query(
    "ad6_preparation_plan",
    """select * from (
  select 1 as step, 'handle missing values' as action from events_null having count(value) < count(*)
  union all select 3, 'optimize data types' union all select 4, 'handle outliers'
  union all select 5, 'encode categoricals' union all select 6, 'scale features')""",
    ("events_null",))
def ad6(spark, sf):
    return A.preparation_plan(view(spark, sf, "events_null"))


@query(
    "ad7_summary",
    """select count(*) as n_rows, 5 as n_columns, 3 as n_numeric, 1 as n_categorical,
    (case when count(event_id)=count(*) then 1 else 0 end) + (case when count(ts)=count(*) then 1 else 0 end)
    + (case when count(user_id)=count(*) then 1 else 0 end) + (case when count(event_type)=count(*) then 1 else 0 end)
    + (case when count(value)=count(*) then 1 else 0 end) + cast(0 as bigint) as complete_columns from events_null""",
    ("events_null",))
def ad7(spark, sf):
    return A.generic_summary(view(spark, sf, "events_null"))
