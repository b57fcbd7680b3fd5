"""Evaluation, comparison and scoring-summary queries."""

from pyspark.sql import functions as F

from ..operators import compare as M
from ..operators import curves as U
from ..operators import metrics as E
from ..operators import scoring as G
from ..operators.ensemble import ensemble_table
from .base import query, rounded, table, view
from .setup import hash_sql

# Weighted class metrics per group; {g} lists the group columns.
CLASS_SQL = """
with l as (select {g} label as k, cast(count(*) as double) as n, cast(sum(case when label = prediction then 1 else 0 end) as double) as h
   from {src} group by {g} label),
 p as (select {g} prediction as k, cast(count(*) as double) as m from {src} group by {g} prediction),
 j as (select l.*, coalesce(m, 0) as m from l left join p using ({g} k))
"""


def class_sql(src: str, by: list[str]) -> str:
    g = "".join(f"{b}, " for b in by)
    return CLASS_SQL.format(g=g, src=src) + f"""
select {g} round(sum(h)/sum(n), 6) as accuracy, round(sum(n*case when m > 0 then h/m else 0 end)/sum(n), 6) as "precision",
 round(sum(n*h/n)/sum(n), 6) as recall, round(sum(n*2*h/(n+m))/sum(n), 6) as f1 from j {'group by ' + ', '.join(by) if by else ''}"""


@query("e1_classification_metrics", class_sql("clspred", []), ("clspred",))
def e1(spark, sf):
    return rounded(E.classification_metrics(view(spark, sf, "clspred"), "label", "prediction"))


@query("e1_classification_metrics_binary", class_sql("binscore", []), ("binscore",))
def e1b(spark, sf):
    return rounded(E.classification_metrics(view(spark, sf, "binscore"), "label", "prediction"))


RANK = """
with g as (select score, cast(sum(label) as double) as p, cast(sum(1-label) as double) as n from binscore group by score),
 t as (select sum(p) as tp, sum(n) as tn from g),
 w as (select g.*, sum(p) over (order by score desc) as cp, sum(n) over (order by score desc) as cn from g)
"""


@query("e2_roc_auc", RANK + "select round(sum(n*(cp - p/2)) / max(tp*tn), 6) as roc_auc from w, t", ("binscore",))
def e2(spark, sf):
    return rounded(E.ranking_metrics(view(spark, sf, "binscore"), "score", "label").select("roc_auc"))


@query("e2_roc_auc_multiclass", """
with s as (select l_returnflag as label, l_quantity/50 as a, l_discount*10 as n, l_tax*10 as r from lineitem),
 u as (select 'A' as c, a as score, cast(label = 'A' as int) as y from s union all
  select 'N', n, cast(label = 'N' as int) from s union all select 'R', r, cast(label = 'R' as int) from s),
 g as (select c, score, cast(sum(y) as double) as p, cast(sum(1-y) as double) as q from u group by c, score),
 w as (select *, sum(p) over (partition by c order by score desc) as cp from g),
 e as (select c, sum(q*(cp - p/2)) / (sum(p)*sum(q)) as auc, sum(p) as k from w group by c)
select round(sum(auc*k)/sum(k), 6) as roc_auc from e""")
def e2b(spark, sf):
    scores = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("label"), (F.col("l_quantity") / 50).alias("a"),
        (F.col("l_discount") * 10).alias("n"), (F.col("l_tax") * 10).alias("r"))
    return rounded(E.roc_auc_weighted(scores, "label", {"A": "a", "N": "n", "R": "r"}))


@query("e2_roc_auc_many_scores", """
with g as (select o_totalprice as score, cast(sum(case when o_orderstatus='F' then 1 else 0 end) as double) as p,
  cast(sum(case when o_orderstatus='F' then 0 else 1 end) as double) as n from orders group by o_totalprice),
 w as (select g.*, sum(p) over (order by score desc) as cp, sum(n) over (order by score desc) as cn from g)
select round(sum(n*(cp - p/2)) / (sum(p)*sum(n)), 6) as roc_auc, round(sum(p*cp/(cp+cn))/sum(p), 6) as pr_auc from w""")
def e2c(spark, sf):
    return rounded(E.ranking_metrics(table(spark, sf, "orders"), "o_totalprice", "o_orderstatus", "F"))


@query("e3_average_precision", RANK + "select round(sum((p/tp) * (cp/(cp+cn))), 6) as pr_auc from w, t", ("binscore",))
def e3(spark, sf):
    return rounded(E.ranking_metrics(view(spark, sf, "binscore"), "score", "label").select("pr_auc"))


REG = """round(avg(abs(label-prediction)), 6) as mae, round(avg((label-prediction)*(label-prediction)), 6) as mse,
 round(sqrt(avg((label-prediction)*(label-prediction))), 6) as rmse,
 round(1 - avg((label-prediction)*(label-prediction))/var_pop(label), 6) as r2"""


@query("e4_regression_metrics", f"select {REG} from regpred", ("regpred",))
def e4(spark, sf):
    return rounded(E.regression_metrics(view(spark, sf, "regpred"), "label", "prediction"))


@query("e5_confusion_matrix", "select label, " + ", ".join(
    f"""count(*) filter (where prediction = '{c}') as "{c}" """ for c in "ANR") + " from clspred group by label", ("clspred",))
def e5(spark, sf):
    return E.confusion_matrix(view(spark, sf, "clspred"), "label", "prediction")


@query("e5_confusion_matrix_binary", """select cast(label as varchar) as label, count(*) filter (where prediction = 0) as "0",
 count(*) filter (where prediction = 1) as "1" from binscore group by label""", ("binscore",))
def e5b(spark, sf):
    return E.confusion_matrix(view(spark, sf, "binscore"), "label", "prediction")


@query("e6_class_report", CLASS_SQL.format(g="", src="clspred") + """
select k as "class", round(case when m > 0 then h/m else 0 end, 6) as "precision", round(h/n, 6) as recall,
 round(2*h/(n+m), 6) as f1, cast(n as bigint) as support from j""", ("clspred",))
def e6(spark, sf):
    return rounded(E.class_report(view(spark, sf, "clspred"), "label", "prediction"))


@query("e7_roc_curve", RANK + """
select score as threshold, round(cn/tn, 6) as fpr, round(cp/tp, 6) as tpr from w, t
union all select null, 0.0::double, 0.0::double""", ("binscore",))
def e7(spark, sf):
    return rounded(U.roc_curve(view(spark, sf, "binscore"), "score", "label"))


@query("e8_precision_recall_curve", RANK + """
select score as threshold, round(cp/(cp+cn), 6) as "precision", round(cp/tp, 6) as recall from w, t
union all select null, 1.0::double, 0.0::double""", ("binscore",))
def e8(spark, sf):
    return rounded(U.precision_recall_curve(view(spark, sf, "binscore"), "score", "label"))


@query("e9_predicted_vs_actual", f"""
select p_partkey, label, prediction, (select least(min(label), min(prediction)) from regpred) as line_low,
 (select greatest(max(label), max(prediction)) from regpred) as line_high from regpred
order by {hash_sql('p_partkey')}, p_partkey limit 1000""", ("regpred",))
def e9(spark, sf):
    return U.predicted_vs_actual(view(spark, sf, "regpred"), "label", "prediction", "p_partkey")


FOLDS = class_sql("preds_long", ["model", "fold"])


@query("e10_compare_models", f"""
with t as ({class_sql('preds_long', ['model'])}), f as ({FOLDS})
select t.model, round(accuracy,3) as accuracy, round(t."precision",3) as "precision", round(t.recall,3) as recall,
 round(t.f1,3) as f1, 0.0::double as roc_auc, round(c.m,3) as cv_mean, round(c.s,3) as cv_std
from t join (select model, avg(f1) as m, stddev_pop(f1) as s from f group by model) c using (model)""", ("preds_long",))
def e10(spark, sf):
    preds = view(spark, sf, "preds_long")
    return M.compare_models(preds, "classification", M.fold_scores(preds, "classification"))


@query("e10_compare_regressors", f"""
with p as (select 'size' as model, label, prediction from regpred union all select 'mean', label, (select avg(label) from regpred) from regpred)
select model, {REG.replace(', 6)', ', 3)')} from p group by model""", ("regpred",))
def e10b(spark, sf):
    rows = view(spark, sf, "regpred").select("label", "prediction")
    mean = rows.agg(F.avg("label")).first()[0]
    both = rows.withColumn("model", F.lit("size")).unionByName(
        rows.withColumns({"prediction": F.lit(mean), "model": F.lit("mean")}))
    return M.compare_models(both, "regression")


BOTH = """b as (select 'score' as model, label, prediction, score from binscore
 union all select 'inverse', label, 1 - prediction, round(1 - score, 2) from binscore)"""


def _both(spark, sf):
    rows = view(spark, sf, "binscore").select("label", "prediction", "score").withColumn("model", F.lit("score"))
    inverse = rows.select("label", (1 - F.col("prediction")).alias("prediction"),
                          F.round(1 - F.col("score"), 2).alias("score"), F.lit("inverse").alias("model"))
    return rows.unionByName(inverse)


def _full_sql() -> str:
    return f"""
with {BOTH}, t as ({class_sql('b', ['model'])}),
 g as (select model, score, cast(sum(label) as double) as p, cast(sum(1-label) as double) as n from b group by model, score),
 w as (select *, sum(p) over (partition by model order by score desc) as cp, sum(n) over (partition by model order by score desc) as cn from g),
 r as (select model, sum(n*(cp - p/2))/(sum(p)*sum(n)) as auc, sum(p*cp/(cp+cn))/sum(p) as ap from w group by model)
select model, round(accuracy,3) as accuracy, round("precision",3) as "precision", round(recall,3) as recall, round(f1,3) as f1,
 round(auc,3) as roc_auc, round(ap,3) as pr_auc, case when model = 'score' then 0.5 else 0.0 end::double as tuning_score
from t join r using (model)"""


@query("e11_compare_models_full", _full_sql(), ("binscore",))
def e11(spark, sf):
    return M.compare_models(_both(spark, sf), "classification", score="score", tuning={"score": 0.5}, full=True)


@query("e12_best_model", f"select model, f1 as score from ({class_sql('preds_long', ['model'])}) order by f1 desc, model limit 1",
       ("preds_long",))
def e12(spark, sf):
    full = M.compare_models(view(spark, sf, "preds_long"), "classification", decimals=6)
    return rounded(M.best_model(full, "classification"))


@query("e13_fold_scores", f"select model, fold, f1 as score from ({FOLDS})", ("preds_long",))
def e13(spark, sf):
    return rounded(M.fold_scores(view(spark, sf, "preds_long"), "classification"))


@query("e13_fold_boxes", f"""
with v as (select model as g, f1 as x from ({FOLDS})),
 q as (select g, quantile_cont(x,0.25) as q1, quantile_cont(x,0.5) as m, quantile_cont(x,0.75) as q3 from v group by g),
 b as (select *, q1-1.5*(q3-q1) as lo, q3+1.5*(q3-q1) as hi from q)
select g as model, round(q1,6) as q1, round(m,6) as median, round(q3,6) as q3,
 round(min(x) filter (where x between lo and hi),6) as whisker_low, round(max(x) filter (where x between lo and hi),6) as whisker_high,
 count(*) filter (where x < lo or x > hi) as outliers, count(*) as n from v join b using (g) group by g, q1, m, q3""",
       ("preds_long",))
def e13b(spark, sf):
    scores = rounded(M.fold_scores(view(spark, sf, "preds_long"), "classification"))
    return rounded(M.fold_boxes(scores))


@query("en4_ensemble_table", f"""
with b as (select label, prediction, score, 'forward' as model from binscore union all
 select label, 1 - prediction, round(1-score,2), 'inverse' from binscore union all
 select label, case when (score*1.5 + round(1-score,2)*0.5)/2.0 >= 0.5 then 1 else 0 end, (score*1.5 + round(1-score,2)*0.5)/2.0, 'voting' from binscore)
select model, case when model = 'voting' then 'ensemble' else 'individual' end as type, round(accuracy,3) as accuracy,
 round("precision",3) as "precision", round(recall,3) as recall, round(f1,3) as f1 from ({class_sql('b', ['model'])})""",
       ("binscore",))
def en4(spark, sf):
    rows = view(spark, sf, "binscore").select("label", "prediction", "score")
    back = F.round(1 - F.col("score"), 2)
    members = {"forward": (F.col("prediction"), F.col("score")), "inverse": (1 - F.col("prediction"), back)}
    return ensemble_table(rows, members, weights=[1.5, 0.5])


@query("x9_residuals", "select p_partkey, round(label - prediction, 6) as residual from regpred", ("regpred",))
def x9(spark, sf):
    return rounded(U.residuals(view(spark, sf, "regpred"), "label", "prediction").select("p_partkey", "residual"))


@query("x9_residual_histogram", """
with v as (select label - prediction as x from regpred), e as (select min(x) as lo, max(x) as hi from v),
 c as (select cast(greatest(least(floor((x-lo)/((hi-lo)/30)), 29), 0) as int) as bin, count(*) as n from v, e group by 1)
select cast(i as int) as bin, round(lo + (hi-lo)/30*i, 6) as low, round(lo + (hi-lo)/30*(i+1), 6) as high, coalesce(n, 0) as n
from e cross join range(30) r(i) left join c on c.bin = i""", ("regpred",))
def x9b(spark, sf):
    return rounded(U.residual_histogram(view(spark, sf, "regpred"), "label", "prediction"))


LEVEL_SQL = """select o_orderkey, score as "Prob_1", round(1 - score, 2) as "Prob_0", greatest(score, round(1 - score, 2)) as "Confidence",
 case when greatest(score, round(1 - score, 2)) <= 0 then null when greatest(score, round(1 - score, 2)) <= 0.6 then 'Low'
  when greatest(score, round(1 - score, 2)) <= 0.8 then 'Medium' else 'High' end as "Confidence_Level" from binscore"""


def _probabilities(spark, sf):
    rows = view(spark, sf, "binscore")
    return rows.select("o_orderkey", F.col("score").alias("Prob_1"), F.round(1 - F.col("score"), 2).alias("Prob_0"))


@query("sc2_confidence", LEVEL_SQL, ("binscore",))
def sc2(spark, sf):
    return G.with_confidence(_probabilities(spark, sf), ["Prob_0", "Prob_1"])


@query("sc3_threshold", """select o_orderkey, case when score >= 0.3 then 1 else 0 end as "Predicted" from binscore""", ("binscore",))
def sc3(spark, sf):
    return G.apply_threshold(_probabilities(spark, sf), "Prob_1", 0.3).select("o_orderkey", "Predicted")


@query("sc4_class_summary", """select prediction as "class", count(*) as n, round(count(*)*100.0/(select count(*) from clspred), 6) as pct
 from clspred group by prediction""", ("clspred",))
def sc4(spark, sf):
    return rounded(G.class_summary(view(spark, sf, "clspred"), "prediction"))


@query("sc4_number_summary", """select round(avg(prediction),6) as mean, round(stddev_samp(prediction),6) as std,
 min(prediction) as "min", max(prediction) as "max" from regpred""", ("regpred",))
def sc4b(spark, sf):
    return rounded(G.number_summary(view(spark, sf, "regpred"), "prediction"))


@query("sc4_level_summary", f"""select "Confidence_Level", count(*) as n from ({LEVEL_SQL}) group by 1""", ("binscore",))
def sc4c(spark, sf):
    return G.level_summary(G.with_confidence(_probabilities(spark, sf), ["Prob_0", "Prob_1"]))
