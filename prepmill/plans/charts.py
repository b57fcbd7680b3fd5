"""Chart-data queries."""

from pyspark.sql import functions as F

from ..operators import charts as H
from .base import query, rounded, table, view


def _hist_sql(src: str, x: str, g: str, bins: int, out_group: bool) -> str:
    tag = f"{g} as {g}," if out_group else ""
    return f"""
with v as (select {g if out_group else '0'} as g, cast({x} as double) as x from {src} where {x} is not null
     {f'and {g} is not null' if out_group else ''}),
 e as (select g, min(x) as lo, max(x) as hi from v group by g),
 p as (select v.g, cast(greatest(least(floor((x-lo)/((hi-lo)/{bins})), {bins - 1}), 0) as int) as bin from v join e using (g)),
 c as (select g, bin, count(*) as n from p group by g, bin),
 f as (select g, lo, hi, cast(i as int) as bin from e cross join range({bins}) r(i))
select {'g as ' + g + ',' if out_group else ''} bin, round(lo + (hi-lo)/{bins}*bin, 6) as low,
 round(lo + (hi-lo)/{bins}*(bin+1), 6) as high, coalesce(n, 0) as n from f left join c using (g, bin)"""


@query("ch1_histogram", _hist_sql("events_null", "value", "0", 30, False), ("events_null",))
def ch1(spark, sf):
    return rounded(H.histogram(view(spark, sf, "events_null"), "value", 30))


@query("ch2_histogram_by", _hist_sql("events_null", "value", "event_type", 20, True), ("events_null",))
def ch2(spark, sf):
    return rounded(H.histogram_by(view(spark, sf, "events_null"), "value", "event_type", 20))


def _box_sql(src: str, x: str, g: str, out_group: bool) -> str:
    return f"""
with v as (select {g if out_group else '0'} as g, {x} as x from {src} where {x} is not null {f'and {g} is not null' if out_group else ''}),
 q as (select g, quantile_cont(x,0.25) as q1, quantile_cont(x,0.5) as m, quantile_cont(x,0.75) as q3 from v group by g),
 b as (select *, q1-1.5*(q3-q1) as lo, q3+1.5*(q3-q1) as hi from q)
select {'g as ' + g + ',' if out_group else ''} round(q1,6) as q1, round(m,6) as median, round(q3,6) as q3,
 min(x) filter (where x between lo and hi) as whisker_low, max(x) filter (where x between lo and hi) as whisker_high,
 count(*) filter (where x < lo or x > hi) as outliers, count(*) as n
from v join b using (g) group by g, q1, m, q3"""


@query("ch3_box_stats", _box_sql("events_null", "value", "0", False), ("events_null",))
def ch3(spark, sf):
    return rounded(H.box_stats(view(spark, sf, "events_null"), "value"))


@query(
    "ch3_box_outliers",
    """select event_id, value from events_null, (select q1-1.5*(q3-q1) as lo, q3+1.5*(q3-q1) as hi from
    (select quantile_cont(value,0.25) as q1, quantile_cont(value,0.75) as q3 from events_null)) where value < lo or value > hi""",
    ("events_null",))
def ch3b(spark, sf):
    return H.box_outliers(view(spark, sf, "events_null"), "value", ["event_id"])


@query("ch4_box_stats_by", _box_sql("events_null", "value", "event_type", True), ("events_null",))
def ch4(spark, sf):
    return rounded(H.box_stats_by(view(spark, sf, "events_null"), "value", "event_type"))


@query(
    "ch5_value_counts",
    'select p_brand as "value", count(*) as n from part group by p_brand order by n desc, p_brand limit 20')
def ch5(spark, sf):
    return H.value_counts(table(spark, sf, "part"), "p_brand")


@query(
    "ch6_cross_tab",
    """select o_orderpriority, count(*) filter (where o_orderstatus='F') as "F",
    count(*) filter (where o_orderstatus='O') as "O", count(*) filter (where o_orderstatus='P') as "P"
    from orders group by o_orderpriority""")
def ch6(spark, sf):
    return H.cross_tab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")


HASHED = "cast(concat('0x', substr(md5(concat('42', ':', cast({k} as varchar))),1,15)) as bigint)"


@query(
    "ch7_scatter",
    f"""select event_id, user_id, value from events_null where value is not null
    order by {HASHED.format(k='event_id')}, event_id limit 1000""", ("events_null",))
def ch7(spark, sf):
    return H.scatter(view(spark, sf, "events_null"), "user_id", "value", "event_id", n=1000)


def _grid_sql(src: str, x: str, y: str, bins: int, g: str | None) -> str:
    pick = f"{g}, " if g else ""
    keep = f"and {g} is not null" if g else ""
    return f"""
with v as (select {pick}cast({x} as double) as x, cast({y} as double) as y from {src}
  where {x} is not null and {y} is not null {keep}),
 e as (select min(x) as a, max(x) as b, min(y) as c, max(y) as d from v)
select {pick}cast(greatest(least(floor((x-a)/((b-a)/{bins})),{bins - 1}),0) as int) as x_bin,
 cast(greatest(least(floor((y-c)/((d-c)/{bins})),{bins - 1}),0) as int) as y_bin, count(*) as n
from v, e group by all"""


@query("ch7_scatter_grid", _grid_sql("lineitem", "l_quantity", "l_extendedprice", 50, None))
def ch7b(spark, sf):
    return H.scatter_grid(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 50)


@query(
    "ch8_scatter_by",
    f"""select event_id, user_id, value, event_type from events_null where value is not null and event_type is not null
    order by {HASHED.format(k='event_id')}, event_id limit 1000""", ("events_null",))
def ch8(spark, sf):
    return H.scatter(view(spark, sf, "events_null"), "user_id", "value", "event_id", "event_type", 1000)


@query("ch8_scatter_grid_by", _grid_sql("events_null", "user_id", "value", 25, "event_type"), ("events_null",))
def ch8b(spark, sf):
    return H.scatter_grid(view(spark, sf, "events_null"), "user_id", "value", 25, "event_type")


def _density_sql(src: str, x: str, g: str, points: int, out_group: bool) -> str:
    return f"""
with v as (select {g if out_group else '0'} as g, cast({x} as double) as x from {src} where {x} is not null
     {f'and {g} is not null' if out_group else ''}),
 f as (select g, count(*) as n, stddev_samp(x)*power(cast(count(*) as double), -0.2) as h, min(x) as a, max(x) as z from v group by g),
 w as (select g, x, count(*) as c from v group by g, x),
 p as (select f.*, i as point, a-3*h + (z-a+6*h)/{points - 1}*i as spot from f cross join range({points}) r(i))
select {'g as ' + g + ',' if out_group else ''} cast(point as int) as point, round(spot, 6) as x,
 round(sum(c*exp(-0.5*((spot-x)/h)*((spot-x)/h)))/(max(n)*max(h)*sqrt(2*pi())), 6) as density
from p join w using (g) group by g, point, spot"""


@query("ch9_density", _density_sql("events_null", "value", "0", 200, False), ("events_null",))
def ch9(spark, sf):
    return rounded(H.density(view(spark, sf, "events_null"), "value"))


@query("ch10_density_by", _density_sql("events_null", "value", "event_type", 200, True), ("events_null",))
def ch10(spark, sf):
    return rounded(H.density_by(view(spark, sf, "events_null"), "value", "event_type"))


LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def pairs_sql(src: str, cols: list[str]) -> str:
    wide = ", ".join(
        f"case when stddev_pop({a}) filter (where {b} is not null) > 0 and stddev_pop({b}) filter (where {a} is not null) > 0 "
        f"then corr({a}, {b}) end as r{i}_{j}"
        for i, a in enumerate(cols) for j, b in enumerate(cols) if j > i
    )
    rows = " union all ".join(
        f"select '{a}' as col_a, '{b}' as col_b, round(r{i}_{j}, 6) as r from corr_wide"
        for i, a in enumerate(cols) for j, b in enumerate(cols) if j > i
    )
    return f"with corr_wide as (select {wide} from {src}) {rows}"


@query("ch11_correlation", pairs_sql("lineitem", LINE_NUMBERS))
def ch11(spark, sf):
    return rounded(H.correlation_pairs(table(spark, sf, "lineitem")))


@query("ch11_correlation_constant", pairs_sql("line_clean", ["l_quantity", "l_tax", "konst", "q2"]), ("line_clean",))
def ch11b(spark, sf):
    return rounded(H.correlation_pairs(view(spark, sf, "line_clean"), ["l_quantity", "l_tax", "konst", "q2"]))


@query(
    "ch11_correlation_matrix",
    " union all ".join(
        f"select '{a}' as col_a, '{b}' as col_b, round(corr({a}, {b}), 6) as r from part"
        for a in ("p_partkey", "p_size", "p_retailprice") for b in ("p_partkey", "p_size", "p_retailprice")
    ))
def ch11c(spark, sf):
    return rounded(H.correlation_matrix(table(spark, sf, "part")))


@query(
    "ch12_class_distribution",
    """select o_orderstatus as "class", count(*) as n, round(count(*)*100.0/(select count(*) from orders),6) as pct
    from orders group by o_orderstatus""")
def ch12(spark, sf):
    return rounded(H.class_distribution(table(spark, sf, "orders"), "o_orderstatus"))


@query(
    "x5_category_summary",
    """select lang as "class", count(*) as n, round(count(*)*100.0/(select count(*) from documents),6) as pct
    from documents group by lang""")
def x5(spark, sf):
    return rounded(H.class_distribution(table(spark, sf, "documents"), "lang"))


PANELS = ["p_size", "p_retailprice", "p_partkey"]


@query(
    "x3_pair_plot",
    "with b as (select " + ", ".join(
        f"cast(greatest(least(floor(({c}-min({c}) over ())/((max({c}) over ()-min({c}) over ())/20.0)),19),0) as int) as {c}"
        for c in PANELS) + " from part) " + " union all ".join(
        f"select '{a}' as x, '{b}' as y, {a} as x_bin, {b} as y_bin, count(*) as n from b group by {', '.join(dict.fromkeys([a, b]))}"
        for i, a in enumerate(PANELS) for b in PANELS[i:]))
def x3(spark, sf):
    return H.pair_plot(table(spark, sf, "part"), PANELS)


@query(
    "x4_target_summary",
    """select o_orderstatus as target, count(*) as n, round(avg(o_totalprice),6) as mean,
    round(quantile_cont(o_totalprice,0.5),6) as median, round(stddev_samp(o_totalprice),6) as std
    from orders group by o_orderstatus""")
def x4(spark, sf):
    return rounded(H.target_summary(table(spark, sf, "orders"), "o_orderstatus", "o_totalprice"))
