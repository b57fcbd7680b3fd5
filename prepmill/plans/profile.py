"""Profile and quality queries."""

from pyspark.sql import functions as F

from ..operators import profile as P
from .base import query, rounded, table, view

ROLE_ROWS = [
    ("event_id", "numeric"), ("ts", "datetime"), ("user_id", "numeric"), ("event_type", "categorical"),
    ("value", "numeric"),
]


@query(
    "pr1_column_roles",
    " union all ".join(
        f"""select {i} as "position", '{c}' as "column", '{r}' as role, count({c}) as present from events_null"""
        for i, (c, r) in enumerate(ROLE_ROWS)
    ),
    ("events_null",),
)
def pr1(spark, sf):
    rows = view(spark, sf, "events_null")
    present = P.missing_counts(rows).select("column", (F.col("rows") - F.col("missing")).alias("present"))
    return P.column_roles(rows).join(present, "column").select("position", "column", "role", "present")


@query(
    "pr1_role_counts",
    """
select role, cast(count(*) as int) as n_columns, cast(sum(missing) as bigint) as missing from (
""" + " union all ".join(
        f"select '{r}' as role, count(*) - count({c}) as missing from events_null" for c, r in ROLE_ROWS
    ) + ") group by role",
    ("events_null",),
)
def pr1b(spark, sf):
    rows = view(spark, sf, "events_null")
    missing = P.column_roles(rows).join(P.missing_counts(rows), "column").groupBy("role").agg(
        F.sum("missing").alias("missing"))
    return P.role_counts(rows).join(missing, "role")


@query(
    "pr2_overview",
    """
select count(*) as n_rows, 5 as n_columns,
  5*count(*)-count(event_id)-count(ts)-count(user_id)-count(event_type)-count(value) as missing_cells,
  round((5*count(*)-count(event_id)-count(ts)-count(user_id)-count(event_type)-count(value))*100.0/(5*count(*)),6) as missing_pct
from events_null""",
    ("events_null",),
)
def pr2(spark, sf):
    return rounded(P.overview(view(spark, sf, "events_null")))


@query(
    "pr3_duplicate_count",
    """
select (select count(*) from part_dup) - count(*) as duplicate_rows from
 (select distinct p_partkey, p_name, p_brand, p_type, p_size, p_retailprice from part_dup)""",
    ("part_dup",),
)
def pr3(spark, sf):
    return P.duplicate_count(view(spark, sf, "part_dup"), exclude=["branch"])


def _info_sql(src: str, cols: list[tuple[str, str]]) -> str:
    return " union all ".join(
        f"""select '{c}' as "column", '{t}' as dtype, count({c}) as non_null, count(*)-count({c}) as nulls,
        round((count(*)-count({c}))*100.0/count(*),6) as null_pct, count(distinct {c}) as n_unique from {src}"""
        for c, t in cols
    )


LINE_TYPES = [
    ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
    ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
    ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"),
]


@query("pr4_column_info", _info_sql("lineitem", LINE_TYPES))
def pr4(spark, sf):
    return rounded(P.column_info(table(spark, sf, "lineitem")))


@query(
    "pr4_column_info_nulls",
    _info_sql("events_null", [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
                              ("event_type", "string"), ("value", "double")]),
    ("events_null",),
)
def pr4b(spark, sf):
    return rounded(P.column_info(view(spark, sf, "events_null")))


def _few(src: str, cols: list[str]) -> str:
    return " union all ".join(
        f"""select '{c}' as "column", case when (select count(distinct {c}) from {src}) <= 10 then
        (select string_agg(v, ', ' order by v) from (select distinct {c} as v from {src} where {c} is not null
         order by v limit 5)) else '' end as sample_values"""
        for c in cols
    )


@query("pr5_sample_values", _few("orders", ["o_orderstatus", "o_orderpriority"]))
def pr5(spark, sf):
    return P.sample_values(table(spark, sf, "orders"))


@query("pr5_sample_values_part", _few("part", ["p_name", "p_brand", "p_type"]))
def pr5b(spark, sf):
    return P.sample_values(table(spark, sf, "part"))


@query(
    "pr6_footprint",
    " union all ".join(
        f"""select '{c}' as "column", cast({e} as bigint) as bytes from customer"""
        for c, e in [
            ("c_custkey", "8*count(c_custkey)"), ("c_name", "sum(strlen(c_name))"),
            ("c_nationkey", "4*count(c_nationkey)"), ("c_acctbal", "8*count(c_acctbal)"),
            ("c_mktsegment", "sum(strlen(c_mktsegment))"),
        ]
    ),
)
def pr6(spark, sf):
    return P.column_footprint(table(spark, sf, "customer"))


@query(
    "pr8_quality_issues",
    """
with u as (select * from line_clean union all select * from line_clean where l_partkey % 10 = 0),
 d as (select count(*) as n from (select distinct * from u)), t as (select count(*) as n from u)
select t.n - d.n as duplicate_rows, round((t.n - d.n)*100.0/t.n, 6) as duplicate_pct,
 cast(0 as bigint) as high_missing_columns, cast((select case when count(distinct konst) <= 1 then 1 else 0 end from u) as bigint) as constant_columns
from t, d""",
    ("line_clean",),
)
def pr8(spark, sf):
    line = view(spark, sf, "line_clean")
    return rounded(P.quality_issues(line.unionByName(line.where("l_partkey % 10 = 0"))))


def _describe_sql(src: str, cols: list[str]) -> str:
    return " union all ".join(
        f"""select '{c}' as "column", count({c}) as "count", round(avg({c}),6) as mean,
        round(stddev_samp({c}),6) as std, round(cast(min({c}) as double),6) as "min", round(quantile_cont({c},0.25),6) as p25,
        round(quantile_cont({c},0.5),6) as p50, round(quantile_cont({c},0.75),6) as p75, round(cast(max({c}) as double),6) as "max"
        from {src}"""
        for c in cols
    )


@query("pr9_describe", _describe_sql("events_null", ["value"]), ("events_null",))
def pr9(spark, sf):
    return rounded(P.describe(view(spark, sf, "events_null"), "value"))


@query("pr9_describe_all", _describe_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def pr9b(spark, sf):
    return rounded(
        P.describe(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    )


def _measure(fn: str, src: str, cols: list[str]) -> str:
    return " union all ".join(f"""select '{c}' as "column", round({fn}({c}),6) as {fn} from {src}""" for c in cols)


SHAPED = ["l_quantity", "l_extendedprice", "l_discount"]


@query("pr10_skewness", _measure("skewness", "lineitem", SHAPED))
def pr10(spark, sf):
    return rounded(P.skewness(table(spark, sf, "lineitem"), SHAPED))


@query("pr11_kurtosis", _measure("kurtosis", "lineitem", SHAPED))
def pr11(spark, sf):
    return rounded(P.kurtosis(table(spark, sf, "lineitem"), SHAPED))


@query(
    "pr12_missing_report",
    """
select * from (
 select 'event_type' as "column", count(*)-count(event_type) as missing, round((count(*)-count(event_type))*100.0/count(*),6) as missing_pct from events_null
 union all
 select 'value', count(*)-count(value), round((count(*)-count(value))*100.0/count(*),6) from events_null
 union all
 select 'user_id', count(*)-count(user_id), round((count(*)-count(user_id))*100.0/count(*),6) from events_null
) where missing > 0""",
    ("events_null",),
)
def pr12(spark, sf):
    return rounded(P.missing_report(view(spark, sf, "events_null")))


def _outlier_sql(src: str, cols: list[str]) -> str:
    return " union all ".join(
        f"""select '{c}' as "column", count(*) filter (where {c} < lo or {c} > hi) as outliers,
        round(max(lo),6) as lower, round(max(hi),6) as upper from {src} cross join
        (select q1-1.5*(q3-q1) as lo, q3+1.5*(q3-q1) as hi from
          (select quantile_cont({c},0.25) as q1, quantile_cont({c},0.75) as q3 from {src}))"""
        for c in cols
    )


@query("pr13_outliers", _outlier_sql("events_null", ["value"]), ("events_null",))
def pr13(spark, sf):
    return rounded(P.outlier_summary(view(spark, sf, "events_null"), ["value", "event_type"]))


@query("pr13_outliers_lineitem", _outlier_sql("lineitem", ["l_quantity", "l_extendedprice"]))
def pr13b(spark, sf):
    return rounded(P.outlier_summary(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"]))


@query(
    "pr14_change_summary",
    """
with a as (select count(*) as n, cast(sum(8 + 8 + 8 + strlen(event_type) + 8 + strlen(props)) as bigint) as b from events),
 c as (select count(*) as n, cast(sum(8 + 8 + 8 + strlen(event_type) + 8 + 4) as bigint) as b from events where value > 50)
select a.n as rows_before, c.n as rows_after, c.n - a.n as rows_changed, 6 as columns_before, 6 as columns_after,
 a.b as bytes_before, c.b as bytes_after, 'plen' as columns_added, 'props' as columns_removed from a, c""",
)
def pr14(spark, sf):
    events = table(spark, sf, "events")
    current = events.where("value > 50").withColumn("plen", F.length("props")).drop("props")
    return P.change_summary(events, current)


@query(
    "pr15_numeric_domains",
    " union all ".join(
        f"""select '{c}' as "column", round(quantile_cont({c},0.5),6) as median, cast(min({c}) as double) as "min",
        cast(max({c}) as double) as "max" from part""" for c in ("p_size", "p_retailprice")
    ),
)
def pr15(spark, sf):
    return rounded(P.numeric_domains(table(spark, sf, "part"), ["p_size", "p_retailprice"]))


@query(
    "pr15_category_domains",
    """select distinct 'p_brand' as "column", p_brand as "value" from part
    union all select distinct 'p_type', p_type from part""",
)
def pr15b(spark, sf):
    return P.category_domains(table(spark, sf, "part"), ["p_brand", "p_type"])


CONTEXT = [
    ("event_id", "bigint", "numeric"), ("user_id", "bigint", "numeric"),
    ("event_type", "string", "categorical"), ("plen", "int", "numeric"),
]


@query(
    "pr16_dataset_context",
    "with t as (select event_id, user_id, event_type, cast(length(props) as int) as plen from events_null join "
    "(select event_id as k, props from events) e on e.k = event_id) "
    + " union all ".join(
        f"""select {i} as "position", '{c}' as "column", '{t}' as dtype, '{r}' as role,
        (select count(*) from t) as n_rows, 4 as n_columns, (select count(*) - count({c}) from t) as missing,
        (select string_agg(coalesce(cast({c} as varchar), ''), ' | ' order by event_id) from
          (select * from t order by event_id limit 3)) as first_values"""
        for i, (c, t, r) in enumerate(CONTEXT)
    ),
    ("events_null",),
)
def pr16(spark, sf):
    nulls = view(spark, sf, "events_null").select("event_id", "user_id", "event_type")
    plen = table(spark, sf, "events").select("event_id", F.length("props").alias("plen"))
    return P.dataset_context(nulls.join(plen, "event_id"), ["event_id"])
