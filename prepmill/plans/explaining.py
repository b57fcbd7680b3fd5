"""Interpretability queries."""

from pyspark.sql import functions as F

from ..operators import explain as X
from ..operators.models import fit_model
from .base import query, rounded, table
from .setup import hash_sql
from .training import TWO, class_problem, many_class_problem, number_problem


def _linear(spark, sf):
    part, prepared = number_problem(spark, sf)
    ready = prepared.slim(part)
    return ready, fit_model("linear", "regression", ready), prepared.preprocessor.names


def _forest(spark, sf):
    train, test, prepared = many_class_problem(spark, sf, passes=False)
    model = fit_model("random_forest", "classification", prepared.apply(train).select("_label", "features"), 3)
    return model, prepared.slim(test), prepared


@query("in1_feature_importance")
def in1(spark, sf):
    model, _, prepared = _forest(spark, sf)
    return rounded(X.feature_importance(spark, model, prepared.preprocessor.names))


@query("in1_importance_sums", """
select model, cast(4 as bigint) as features, 1.0::double as total from (values ('adaboost'), ('decision_tree'), ('lightgbm')) as m(model)""")
def in1b(spark, sf):
    """Importances of single and composite models (boosted votes, one-vs-rest) name every slot and sum to one."""
    train, _, prepared = many_class_problem(spark, sf)
    ready = prepared.slim(train).persist()
    sizes = {"adaboost": {"rounds": 3, "maxDepth": 3}, "decision_tree": {"maxDepth": 6}, "lightgbm": {"maxIter": 2, "maxDepth": 2}}
    out = None
    for name, params in sizes.items():
        model = fit_model(name, "classification", ready, len(prepared.classes), None, params, prepared.key)
        found = X.feature_importance(spark, model, prepared.preprocessor.names)
        one = found.agg(F.count_distinct("feature").alias("features"), F.round(F.sum("importance"), 6).alias("total"))
        one = one.withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("in2_coefficients", TWO.format(a="p_size", b="p_partkey") + """
select 'p_size' as feature, round(wa, 5) as coefficient from w union all select 'p_partkey', round(wb, 5) from w""")
def in2(spark, sf):
    _, model, names = _linear(spark, sf)
    return rounded(X.coefficients(spark, model, names), 5)


@query("in2_coefficients_classes")
def in2b(spark, sf):
    train, _, prepared = many_class_problem(spark, sf)
    model = fit_model("logistic", "classification", prepared.slim(train), 3)
    return rounded(X.coefficients(spark, model, prepared.preprocessor.names))


# Shuffled copies of a linear model's inputs: the value of the next row in hashed order.
ORDER = "cast(concat('0x', substr(md5(concat_ws(':', concat('42:order', i), cast(p_partkey as varchar))),1,15)) as bigint)"


@query("in3_permutation_importance", TWO.format(a="p_size", b="p_partkey") + f""",
 f as (select p_partkey, p_size, p_retailprice as y, my + wa*(p_size-ma) + wb*(p_partkey-mb) as fit from part, m, w),
 r as (select f.*, i, coalesce(lead(p_size) over o, first_value(p_size) over o) as d1,
   coalesce(lead(p_partkey) over o, first_value(p_partkey) over o) as d2 from f cross join range(10) t(i)
   window o as (partition by i order by {ORDER}, p_partkey)),
 v as (select i, 1 - avg(power(y - fit - wa*(d1-p_size), 2))/var_pop(y) as ra,
   1 - avg(power(y - fit - wb*(d2-p_partkey), 2))/var_pop(y) as rb from r, w group by i),
 z as (select 1 - avg(power(y - fit, 2))/var_pop(y) as r0 from f)
select 'p_size' as feature, round(avg(r0 - ra), 5) as importance, round(stddev_pop(ra), 5) as std from v, z
union all select 'p_partkey', round(avg(r0 - rb), 5), round(stddev_pop(rb), 5) from v, z""")
def in3(spark, sf):
    ready, model, names = _linear(spark, sf)
    return rounded(X.permutation_importance(model, ready.persist(), names, "p_partkey"), 5)


@query("in4_partial_dependence", TWO.format(a="p_size", b="p_partkey") + """,
 g as (select p_size as v, 'p_size' as feature from part group by p_size
   union all select lo + (hi-lo)*i/99, 'p_partkey' from range(100) r(i), (select quantile_cont(p_partkey, 0.05) as lo,
     quantile_cont(p_partkey, 0.95) as hi from part))
select feature, round(cast(v as double), 3) as "value", round(case feature when 'p_size' then my + wa*(v-ma) else my + wb*(v-mb) end, 3) as mean_output
from g, m, w""")
def in4(spark, sf):
    ready, model, names = _linear(spark, sf)
    return rounded(X.partial_dependence(model, ready, names, ["p_size", "p_partkey"]), 3)


@query("in5_linear_attributions", TWO.format(a="p_size", b="p_partkey") + """
select p_partkey, 'p_size' as feature, cast(p_size as double) as "value", round(wa*(p_size-ma), 4) as attribution from part, m, w
union all select p_partkey, 'p_partkey', cast(p_partkey as double), round(wb*(p_partkey-mb), 4) from part, m, w""")
def in5(spark, sf):
    ready, model, names = _linear(spark, sf)
    weights = [float(c) for c in model.core.coefficients]
    return rounded(X.linear_attributions(ready, names, weights, "p_partkey"), 4)


@query("in6_shapley_values")
def in6(spark, sf):
    _, test, prepared = class_problem(spark, sf)
    train, _, _ = class_problem(spark, sf)
    model = fit_model("decision_tree", "classification", prepared.slim(train), 2)
    return rounded(X.shapley_values(model, prepared.slim(test), prepared.preprocessor.names, "event_id"))


@query("in6_shapley_linear", TWO.format(a="p_size", b="p_partkey") + f""",
 x as (select * from part order by {hash_sql('p_partkey')}, p_partkey limit 50),
 g as (select avg(p_size) as g1, avg(p_partkey) as g2 from
   (select * from part order by {hash_sql('p_partkey', '42:background')}, p_partkey limit 10))
select p_partkey, 'p_size' as feature, cast(p_size as double) as "value", round(wa*(p_size-g1), 3) as attribution from x, w, g
union all select p_partkey, 'p_partkey', cast(p_partkey as double), round(wb*(p_partkey-g2), 3) from x, w, g""")
def in6b(spark, sf):
    ready, model, names = _linear(spark, sf)
    return rounded(X.shapley_values(model, ready, names, "p_partkey"), 3)


@query("in7_attribution_summary", TWO.format(a="p_size", b="p_partkey") + """
select 'p_size' as feature, round(avg(abs(wa*(p_size-ma))), 4) as mean_abs from part, m, w
union all select 'p_partkey', round(avg(abs(wb*(p_partkey-mb))), 4) from part, m, w""")
def in7(spark, sf):
    ready, model, names = _linear(spark, sf)
    weights = [float(c) for c in model.core.coefficients]
    return rounded(X.attribution_summary(X.linear_attributions(ready, names, weights, "p_partkey")), 4)


@query("in7_attribution_breakdown", TWO.format(a="p_size", b="p_partkey") + """
select p_partkey, 'p_size' as feature, cast(p_size as double) as "value", round(wa*(p_size-ma), 4) as attribution from part, m, w
  where p_partkey = (select min(p_partkey) from part)
union all select p_partkey, 'p_partkey', cast(p_partkey as double), round(wb*(p_partkey-mb), 4) from part, m, w
  where p_partkey = (select min(p_partkey) from part)""")
def in7b(spark, sf):
    ready, model, names = _linear(spark, sf)
    weights = [float(c) for c in model.core.coefficients]
    first = table(spark, sf, "part").agg(F.min("p_partkey")).first()[0]
    found = X.linear_attributions(ready, names, weights, "p_partkey")
    return rounded(X.attribution_breakdown(found, "p_partkey", first), 4)


@query("in9_explain_predictions")
def in9(spark, sf):
    model, test, prepared = _forest(spark, sf)
    names = prepared.preprocessor.names
    importance = X.feature_importance(spark, model, names)
    return rounded(X.explain_predictions(importance, test, names, "row_key"))
