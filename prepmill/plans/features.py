"""Feature engineering and preprocessing queries."""

from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import preprocess as R
from ..session import spread
from .base import query, rounded, table, view

#: A table that comes in few splits is fitted in tasks of at least so many rows.
ROWS_PER_SPLIT = 25_000


@query("f1_interactions", """
select l_orderkey, l_linenumber, round(l_quantity * l_discount, 6) as l_quantity_l_discount_interaction,
 round(l_extendedprice * l_tax, 6) as l_extendedprice_l_tax_interaction from lineitem""")
def f1(spark, sf):
    made = X.interactions(table(spark, sf, "lineitem"), [("l_quantity", "l_discount"), ("l_extendedprice", "l_tax")])
    return rounded(made.select(
        "l_orderkey", "l_linenumber", "l_quantity_l_discount_interaction", "l_extendedprice_l_tax_interaction"))


FOUR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("f2_auto_interactions", "select l_orderkey, l_linenumber, " + ", ".join(
    f"round({a} * {b}, 6) as {a}_{b}_interaction"
    for i, a in enumerate(FOUR) for b in FOUR[i + 1:]) + " from lineitem")
def f2(spark, sf):
    made = X.auto_interactions(table(spark, sf, "lineitem"), 10, columns=FOUR)
    return rounded(made.select("l_orderkey", "l_linenumber", *[c for c in made.columns if c.endswith("_interaction")]))


@query("f2_auto_interactions_corr", """
select l_orderkey, l_linenumber, round(l_quantity * q2, 6) as l_quantity_q2_interaction from line_clean""",
       ("line_clean",))
def f2b(spark, sf):
    line = view(spark, sf, "line_clean")
    made = X.auto_interactions(line, 1, "corr", ["l_quantity", "l_discount", "l_tax", "q2"])
    return rounded(made.select("l_orderkey", "l_linenumber", "l_quantity_q2_interaction"))


@query("f3_top_correlated", """
select * from (select 'p_partkey' as feature, round(abs(corr(p_partkey, p_retailprice)), 6) as abs_r from part
 union all select 'p_size', round(abs(corr(p_size, p_retailprice)), 6) from part) order by abs_r desc, feature limit 1""")
def f3(spark, sf):
    return rounded(X.top_correlated(table(spark, sf, "part"), "p_retailprice", 1))


def _chi_sql(src: str, y: str, cols: list[str]) -> str:
    return " union all ".join(f"""
select '{c}' as feature, round(sum(power(o - s*k/n, 2) / (s*k/n)), 6) as chi2 from
 (select {y} as y, cast(count(*) as double) as k, cast(sum({c}) as double) as o from {src} group by {y}),
 (select cast(count(*) as double) as n, cast(sum({c}) as double) as s from {src})""" for c in cols)


@query("f4_chi_square", _chi_sql("lineitem", "l_returnflag", ["l_quantity", "l_linenumber", "l_discount", "l_tax"]))
def f4(spark, sf):
    line = table(spark, sf, "lineitem")
    return rounded(X.chi_square(line, "l_returnflag", ["l_quantity", "l_linenumber", "l_discount", "l_tax"]))


def _mi_sql(src: str, y: str, cols: list[str], bins: int = 10) -> str:
    return " union all ".join(f"""
select '{c}' as feature, (
 with m as (select cast(min({c}) as double) as lo, cast(max({c}) as double) as hi from {src}),
  x as (select {y} as y, least(floor(({c}-lo)/(hi-lo)*{bins}), {bins - 1}) as v from {src}, m),
  j as (select y, v, cast(count(*) as double) as c from x group by y, v),
  r as (select y, sum(c) as cy from j group by y), q as (select v, sum(c) as cv from j group by v),
  n as (select sum(c) as n from j)
 select round(sum(c/n*ln(c*n/(cy*cv))), 6) from j join r using (y) join q using (v), n) as mi""" for c in cols)


@query("f5_mutual_information", _mi_sql("part", "p_type", ["p_size", "p_retailprice"]))
def f5(spark, sf):
    return rounded(X.mutual_information(table(spark, sf, "part"), "p_type", ["p_size", "p_retailprice"]))


@query("f6_eliminate_features")
def f6(spark, sf):
    names = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    line = spread(table(spark, sf, "lineitem").select(*names, "l_returnflag"), ROWS_PER_SPLIT)
    return X.eliminate_features(line, "l_returnflag", 2, names)


def _nulls(spark, sf):
    return view(spark, sf, "events_null").select("event_id", "event_type", "value")


def _register_impute(strategy: str, sql: str) -> None:
    @query(f"f7_impute_{strategy}", f"""
select event_id, event_type, round(coalesce(value, ({sql})), 6) as value from events_null""", ("events_null",))
    def run(spark, sf):
        return rounded(R.impute_numeric(_nulls(spark, sf), ["value"], strategy))


_register_impute("mean", "select avg(value) from events_null")
_register_impute("median", "select quantile_cont(value, 0.5) from events_null")
_register_impute(
    "most_frequent",
    "select value from events_null where value is not null group by value order by count(*) desc, value limit 1")


@query("f8_impute_categorical", """
select event_id, coalesce(event_type, (select event_type from events_null where event_type is not null
 group by event_type order by count(*) desc, event_type limit 1)) as event_type, value from events_null""",
       ("events_null",))
def f8(spark, sf):
    return R.impute_categorical(_nulls(spark, sf), ["event_type"])


SCALES = {
    "standard": "({c} - avg({c}) over ()) / stddev_pop({c}) over ()",
    "minmax": "({c} - min({c}) over ()) / (max({c}) over () - min({c}) over ())",
    "robust": "({c} - quantile_cont({c}, 0.5) over ()) / (quantile_cont({c}, 0.75) over () - quantile_cont({c}, 0.25) over ())",
}


def _register_scale(number: int, method: str) -> None:
    form = SCALES[method]

    @query(f"f{number}_scale_{method}", f"""
select l_orderkey, l_linenumber, round({form.format(c='l_quantity')}, 6) as l_quantity,
 round({form.format(c='l_extendedprice')}, 6) as l_extendedprice, 0.0::double as konst from line_clean""",
           ("line_clean",))
    def run(spark, sf):
        line = view(spark, sf, "line_clean").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "konst")
        return rounded(R.scale(line, ["l_quantity", "l_extendedprice", "konst"], method))


_register_scale(9, "standard")
_register_scale(10, "minmax")
_register_scale(11, "robust")


@query("f12_one_hot", """
select l_orderkey, l_linenumber, case when l_returnflag = 'N' then 1.0 else 0.0 end::double as "l_returnflag_N",
 case when l_returnflag = 'R' then 1.0 else 0.0 end::double as "l_returnflag_R",
 case when l_linestatus = 'O' then 1.0 else 0.0 end::double as "l_linestatus_O" from lineitem""")
def f12(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return R.one_hot(line, ["l_returnflag", "l_linestatus"])


@query("f13_ordinal", """
with codes as (select p_brand as k, row_number() over (order by p_brand) - 1 as code from
 (select distinct p_brand from part))
select p_partkey, coalesce(code, -1) as p_brand from part left join codes on k = p_brand""")
def f13(spark, sf):
    part = table(spark, sf, "part")
    return R.ordinal(part, ["p_brand"], part.select("p_partkey", "p_brand"))


@query("f14_target_encode", """
with g as (select p_brand as k, avg(p_retailprice) as m, cast(count(*) as double) as c from part group by p_brand),
 p as (select avg(p_retailprice) as pr from part)
select p_partkey, round(pr*(1-1/(1+exp(-(c-20)/10))) + m/(1+exp(-(c-20)/10)), 6) as p_brand, p_retailprice
from part join g on k = p_brand, p""")
def f14(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    return rounded(R.target_encode(part, ["p_brand"], "p_retailprice"))


@query("f15_column_pipeline", """
with b as (select event_id, coalesce(value, (select avg(value) from events_null)) as v, coalesce(event_type,
  (select event_type from events_null where event_type is not null group by 1 order by count(*) desc, 1 limit 1)) as t
  from events_null)
select event_id, round((v - avg(v) over ()) / stddev_pop(v) over (), 6) as "value",
 case when t = 'error' then 1.0 else 0.0 end::double as event_type_error,
 case when t = 'purchase' then 1.0 else 0.0 end::double as event_type_purchase,
 case when t = 'signup' then 1.0 else 0.0 end::double as event_type_signup,
 case when t = 'view' then 1.0 else 0.0 end::double as event_type_view from b""", ("events_null",))
def f15(spark, sf):
    rows = _nulls(spark, sf)
    prepared = R.fit_preprocessor(rows, ["value", "event_type"], "mean", "standard", "onehot")
    return rounded(R.transformed_preview(rows, prepared, ["event_id"]))


@query("f15_column_pipeline_ordinal", """
with codes as (select p_brand as k, row_number() over (order by p_brand) - 1 as code from (select distinct p_brand from part))
select p_partkey, (p_size - (select min(p_size) from part)) / cast((select max(p_size) - min(p_size) from part) as double) as size01,
 cast(code as double) as p_brand from part join codes on k = p_brand""")
def f15b(spark, sf):
    part = table(spark, sf, "part")
    prepared = R.fit_preprocessor(part, ["p_size", "p_brand"], "median", "minmax", "ordinal")
    return R.transformed_preview(part, prepared, ["p_partkey"]).withColumnRenamed("p_size", "size01")


@query("f15_column_pipeline_target", """
with g as (select p_type as k, avg(p_retailprice) as m, cast(count(*) as double) as c from part group by p_type),
 p as (select avg(p_retailprice) as pr from part)
select p_partkey, round((p_size - (select quantile_cont(p_size, 0.5) from part)) /
  (select quantile_cont(p_size, 0.75) - quantile_cont(p_size, 0.25) from part), 6) as p_size,
 round(pr*(1-1/(1+exp(-(c-20)/10))) + m/(1+exp(-(c-20)/10)), 6) as p_type from part join g on k = p_type, p""")
def f15c(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_type", "p_retailprice")
    prepared = R.fit_preprocessor(part, ["p_size", "p_type"], "median", "robust", "target", "p_retailprice")
    return rounded(R.transformed_preview(part, prepared, ["p_partkey"]))


@query("f15_many_categories", """
with g as (select c_name as k, avg(c_acctbal) as m, cast(count(*) as double) as c from customer group by c_name),
 p as (select avg(c_acctbal) as pr from customer)
select c_custkey, round(pr*(1-1/(1+exp(-(c-20)/10))) + m/(1+exp(-(c-20)/10)), 6) as c_name from customer join g on k = c_name, p""")
def f15d(spark, sf):
    """Target means of a column with a category for each row."""
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    prepared = R.fit_preprocessor(rows, ["c_name"], encoding="target", target="c_acctbal")
    return rounded(R.transformed_preview(rows, prepared, ["c_custkey"]))


@query("f12_one_hot_vector", """
with codes as (select c_name as k, row_number() over (order by c_name) - 1 as code from (select distinct c_name from customer))
select c_custkey, cast((select count(*) - 1 from codes) as int) as size,
 case when code > 0 then cast(code - 1 as int) end as slot from customer join codes on k = c_name""")
def f12b(spark, sf):
    """One-hot codes of a column with a category for each row, as sparse vectors."""
    rows = R.one_hot_vector(table(spark, sf, "customer").select("c_custkey", "c_name"), ["c_name"])
    vector = F.unwrap_udt("c_name_onehot")
    return rows.select("c_custkey", vector["size"].alias("size"), F.get(vector["indices"], F.lit(0)).alias("slot"))


@query("f16_preview", """
select l_orderkey, l_linenumber, l_quantity, case when l_returnflag = 'N' then 1.0 else 0.0 end::double as "l_returnflag_N",
 case when l_returnflag = 'R' then 1.0 else 0.0 end::double as "l_returnflag_R"
from lineitem order by l_orderkey, l_linenumber, l_quantity limit 5""")
def f16(spark, sf):
    line = table(spark, sf, "lineitem")
    prepared = R.fit_preprocessor(line, ["l_quantity", "l_returnflag"])
    shown = R.transformed_preview(line, prepared, ["l_orderkey", "l_linenumber"])
    return shown.orderBy("l_orderkey", "l_linenumber", "l_quantity").limit(5)


@query("f17_datetime_parts", """
select o_orderkey, cast(year(o_orderdate) as int) as o_orderdate_year, cast(month(o_orderdate) as int) as o_orderdate_month,
 cast(day(o_orderdate) as int) as o_orderdate_day, cast(dayofweek(o_orderdate) + 1 as int) as o_orderdate_weekday,
 cast(hour(o_orderdate) as int) as o_orderdate_hour from orders""")
def f17(spark, sf):
    return X.datetime_parts(table(spark, sf, "orders").select("o_orderkey", "o_orderdate")).drop("o_orderdate")


@query("in8_numeric_matrix", """
with codes as (select event_type as k, row_number() over (order by event_type) - 1 as code from
 (select distinct event_type from events_null where event_type is not null))
select event_id, cast(user_id as double) as user_id, cast(coalesce(code, -1) as double) as event_type,
 round(coalesce(value, (select avg(value) from events_null)), 6) as value
from events_null left join codes on k = event_type""", ("events_null",))
def in8(spark, sf):
    rows = view(spark, sf, "events_null")
    return rounded(R.numeric_matrix(rows, ["ts", "user_id", "event_type", "value"]))
