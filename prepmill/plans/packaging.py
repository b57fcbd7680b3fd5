"""Saving, loading, scoring and reporting queries."""

from pyspark.sql import functions as F

from ..operators import package as K
from ..operators import scoring as G
from ..operators import training as T
from ..operators.models import fit_model
from ..operators.split import train_test
from ..session import scratch_path
from .base import query, rounded, table, view
from .evaluation import class_sql
from .training import TWO, class_problem, many_class_problem, number_problem


@query("mg1_package", TWO.format(a="p_size", b="p_partkey") + """
select p_partkey, round(my + wa*(p_size-ma) + wb*(p_partkey-mb), 4) as prediction from part, m, w""")
def mg1(spark, sf):
    part, prepared = number_problem(spark, sf)
    model = fit_model("linear", "regression", prepared.slim(part))
    path = K.save_package(
        spark, scratch_path(spark, "model"), model, prepared.preprocessor, prepared.features, prepared.target,
        shape=(part.count(), len(part.columns)))
    loaded = K.load_package(spark, path)
    return rounded(loaded.transform(part).select("p_partkey", "prediction"), 4)


@query("mg1_package_facts")
def mg1b(spark, sf):
    train, test, prepared = class_problem(spark, sf)
    model = fit_model("logistic", "classification", prepared.slim(train), 2)
    model.classes = prepared.classes
    metrics = T.score_predictions(model.transform(prepared.slim(test)), prepared)
    path = K.save_package(
        spark, scratch_path(spark, "model"), model, prepared.preprocessor, prepared.features, prepared.target, metrics)
    facts = K.load_package(spark, path).facts
    rows = [(k, float(v)) for k, v in facts["metrics"].items()]
    return rounded(spark.createDataFrame(rows, "metric string, value double"))


@query("mg2_report")
def mg2(spark, sf):
    rows = view(spark, sf, "imb").select("event_id", "user_id", "plen", "label")
    train, test = train_test(rows, "event_id", 0.2, "label")
    results, failures = T.train_models(
        train, test, ["user_id", "plen"], "label", "event_id", ["logistic", "naive_bayes"], cv_folds=0)
    asked = T.failures_table(spark, results, failures)
    return rounded(asked.join(K.comparison_report(spark, results), "model", "left"))


@query("mg2_reloaded", """
with c as (select label, count(*) as n, cast(floor(count(*) * 0.2 + 0.5) as bigint) as held from imb group by label)
select model, (select sum(held) from c)::bigint as n_rows, cast(0 as bigint) as changed
from (values ('decision_tree'), ('naive_bayes'), ('svm')) as m(model)""", ("imb",))
def mg2b(spark, sf):
    """Models read back score every held-out row as they did before."""
    train, test, prepared = class_problem(spark, sf)
    ready = prepared.slim(train).persist()
    out = None
    for name in ("decision_tree", "naive_bayes", "svm"):
        model = fit_model(name, "classification", ready, 2)
        path = K.save_package(
            spark, scratch_path(spark, "model"), model, prepared.preprocessor, prepared.features, prepared.target)
        old = model.transform(prepared.slim(test)).select("event_id", F.col("prediction").alias("old"))
        new = K.load_package(spark, path).transform(test).select("event_id", "prediction")
        one = old.join(new, "event_id", "full").agg(
            F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("old").eqNullSafe(F.col("prediction"))).alias("changed"))
        one = one.withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("mg3_analysis_facts", f"""
with o as (select count(*) as n, 5*count(*)-count(event_id)-count(ts)-count(user_id)-count(event_type)-count(value) as miss from events_null),
 k as (select event_type, count(*) as n from events_null where event_type is not null group by event_type),
 sc as ({class_sql('preds_long', ['model'])}),
 f as (select 'overview' as section, 'n_rows' as item, cast(n as double) as "value" from o
  union all select 'overview', 'n_columns', 5 from o union all select 'overview', 'missing_cells', miss from o
  union all select 'overview', 'missing_pct', miss*100.0/(5*n) from o
  union all select 'overview', 'duplicate_rows', 0 union all select 'overview', 'duplicate_pct', 0
  union all select 'target', 'imbalance_ratio', max(n)*1.0/min(n) from k
  union all select 'target', 'is_imbalanced', case when max(n)*1.0/min(n) > 2 then 1 else 0 end from k
  union all select 'models', model, f1 from sc
  union all select 'recommendation', 'handle missing values', 1 from o where miss*100.0/(5*n) > 10
  union all select 'recommendation', 'balance classes', 1 from k having max(n)*1.0/min(n) > 2
  union all select 'recommendation', 'improve models', 1 from sc having max(f1) < 0.7)
select section, item, round("value", 6) as "value" from f""", ("events_null", "preds_long"))
def mg3(spark, sf):
    return rounded(K.analysis_facts(
        view(spark, sf, "events_null"), "event_type", "classification", view(spark, sf, "preds_long")))


@query("sc1_score_table")
def sc1(spark, sf):
    train, test, prepared = many_class_problem(spark, sf)
    model = fit_model("logistic", "classification", prepared.slim(train), 3)
    scored = model.transform(prepared.apply(test, labelled=False))
    return rounded(G.with_confidence(
        G.predicted_columns(scored, prepared.classes, ["row_key"]), [f"Prob_{c}" for c in prepared.classes]))


# Gaussian variances are raised by 1e-9 of the widest feature's, as the estimator does.
@query("sc1_score_table_bayes", """
with e as (select 1e-9 * greatest(var_pop(user_id), var_pop(plen)) as eps from imb),
 s as (select label, count(*)*1.0/(select count(*) from imb) as pr, avg(user_id) as mu, avg(plen) as mp,
  var_pop(user_id) + max(eps) as vu, var_pop(plen) + max(eps) as vp from imb, e group by label),
 j as (select event_id, s.label as c, ln(pr) - 0.5*(ln(2*pi()*vu) + (user_id-mu)*(user_id-mu)/vu)
   - 0.5*(ln(2*pi()*vp) + (plen-mp)*(plen-mp)/vp) as ll from imb, s),
 t as (select event_id, max(ll) filter (where c = 0) as l0, max(ll) filter (where c = 1) as l1 from j group by event_id),
 p as (select event_id, 1/(1+exp(l1-l0)) as p0, 1/(1+exp(l0-l1)) as p1 from t)
select event_id, case when p1 > p0 then '1' else '0' end as "Predicted", round(p0, 6) as "Prob_0", round(p1, 6) as "Prob_1",
 round(greatest(p0, p1), 6) as "Confidence", case when greatest(p0, p1) <= 0.6 then 'Low' when greatest(p0, p1) <= 0.8 then 'Medium'
  else 'High' end as "Confidence_Level" from p""", ("imb",))
def sc1b(spark, sf):
    rows = view(spark, sf, "imb").select("event_id", "user_id", "plen", "label")
    prepared = T.prepare(rows, ["user_id", "plen"], "label", "event_id", "classification")
    model = fit_model("naive_bayes", "classification", prepared.slim(rows), 2)
    scored = model.transform(prepared.apply(rows.drop("label"), labelled=False))
    return rounded(G.with_confidence(
        G.predicted_columns(scored, prepared.classes, ["event_id"]), ["Prob_0", "Prob_1"]))


@query("x10_reload_models", TWO.format(a="p_size", b="p_partkey") + """,
 one as (select regr_slope(p_retailprice, p_size) as k, regr_intercept(p_retailprice, p_size) as c from part)
select 'both' as model, p_partkey, round(my + wa*(p_size-ma) + wb*(p_partkey-mb), 3) as prediction from part, m, w
union all select 'size', p_partkey, round(c + k*p_size, 3) from part, one""")
def x10(spark, sf):
    folder = scratch_path(spark, "models")
    for name, features in (("both", ("p_size", "p_partkey")), ("size", ("p_size",))):
        part, prepared = number_problem(spark, sf, features)
        model = fit_model("linear", "regression", prepared.slim(part))
        K.save_package(spark, f"{folder}/{name}", model, prepared.preprocessor, prepared.features, prepared.target)
    part = table(spark, sf, "part")
    out = None
    for name, package in K.load_packages(spark, folder).items():
        scored = package.transform(part).select(F.lit(name).alias("model"), "p_partkey", "prediction")
        out = scored if out is None else out.unionByName(scored)
    return rounded(out, 3)
