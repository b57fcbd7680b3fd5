"""Model training, tuning and ensemble queries.

Models with a closed form have exact checks; iterative ones are checked by rows here
and by invariants in the tests.
"""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.ranges import running_max
from ..operators import ensemble as N
from ..operators import training as T
from ..operators.balance import undersample
from ..operators.compare import fold_scores, fold_summary
from ..operators.models import fit_model
from ..operators.neighbors import feature_array, knn_predict
from ..operators.split import train_test, with_folds
from ..operators.tuning import calibrate, fold_features, search
from ..session import spread
from .base import query, rounded, table, view

#: A table that comes in one split is fitted in tasks of at least so many rows.
ROWS_PER_SPLIT = 25_000


def class_problem(spark, sf):
    """Events: is the value above 100?  (train, test, preparation)"""
    rows = spread(view(spark, sf, "imb").select("event_id", "user_id", "plen", "label"))
    train, test = train_test(rows, "event_id", 0.2, "label")
    train = train.persist()
    prepared = T.prepare(train, ["user_id", "plen"], "label", "event_id", "classification", scaling="standard")
    return train, test, prepared


def many_class_problem(spark, sf, passes=True):
    """Lineitem: the return flag (three classes).  Without ``passes`` the training rows have no key and serve a fit that reads them a few times."""
    line = spread(table(spark, sf, "lineitem"), passes=passes)
    rows = line.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("string")).alias("row_key"),
        "l_quantity", "l_discount", "l_tax", "l_linestatus", "l_returnflag")
    train, test = train_test(rows, "row_key", 0.2, "l_returnflag")
    train = (train if passes else train.drop("row_key")).persist()
    prepared = T.prepare(
        train, ["l_quantity", "l_discount", "l_tax", "l_linestatus"], "l_returnflag", "row_key", "classification",
        scaling="minmax")
    return train, test, prepared


def number_problem(spark, sf, features=("p_size", "p_partkey")):
    """Part: the retail price, fitted and scored on the whole table."""
    part = spread(table(spark, sf, "part").select("p_partkey", "p_size", "p_type", "p_retailprice"), ROWS_PER_SPLIT)
    prepared = T.prepare(part, list(features), "p_retailprice", "p_partkey", "regression")
    return part, prepared


def _classify(spark, sf, name, params=None, many=False):
    train, test, prepared = (many_class_problem if many else class_problem)(spark, sf)
    ready = prepared.slim(train).persist()
    model = fit_model(name, "classification", ready, len(prepared.classes), None, params, prepared.key)
    ready.unpersist()
    scored = model.transform(prepared.slim(test))
    return rounded(scored.select(prepared.key, "_label", "prediction", vector_to_array("probability")[1].alias("p1")))


def _regress(spark, sf, name, params=None, features=("p_size", "p_partkey"), digits=6):
    part, prepared = number_problem(spark, sf, features)
    ready = prepared.slim(part)
    model = fit_model(name, "regression", ready.persist(), 0, None, params, prepared.key)
    scored = model.transform(ready)
    return rounded(scored.select("p_partkey", "prediction"), digits)


@query("t1_train_models")
def t1(spark, sf):
    rows = spread(view(spark, sf, "imb").select("event_id", "user_id", "plen", "label"))
    train, test = train_test(rows, "event_id", 0.2, "label")
    train = train.persist()
    results, failures = T.train_models(
        train, test, ["user_id", "plen"], "label", "event_id", ["logistic", "decision_tree", "naive_bayes"],
        cv_folds=5)
    return _with_failures(spark, results, failures)


def _with_failures(spark, results, failures):
    """Metrics of the trained models, and a row for each that failed."""
    asked = T.failures_table(spark, results, failures)
    return rounded(asked.join(T.results_table(spark, results), "model", "left") if results else asked)


@query("t1_resampled", """
select * from (values ('linear', true, false, cast(null as boolean)), ('naive_bayes', false, true, true)) as v(model, failed, scored, balanced)""")
def t1c(spark, sf):
    """Undersampling inside each fit: the test part is scored whole, the minority class is found more often,
    and a model that cannot be fitted is a row of its own."""
    rows = spread(view(spark, sf, "imb").select("event_id", "user_id", "plen", "label"))
    train, test = train_test(rows, "event_id", 0.2, "label")
    options = (train, test, ["user_id", "plen"], "label", "event_id", ["naive_bayes", "linear"])
    results, failures = T.train_models(*options, cv_folds=3, resample="undersample")
    n = test.count()
    mine = {k: r.predictions.agg(F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("p")).first() for k, r in results.items()}
    facts = [(k, r["n"] == n, 0.1 < r["p"] < 0.9) for k, r in mine.items()]
    known = spark.createDataFrame(facts, "model string, scored boolean, balanced boolean")
    asked = T.failures_table(spark, results, failures).drop("error").join(known, "model", "left")
    return asked.withColumn("scored", F.coalesce("scored", F.lit(False)))


@query("t1_train_regressors")
def t1b(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_type", "p_retailprice")
    train, test = train_test(part, "p_partkey", 0.2)
    results, failures = T.train_models(
        train, test, ["p_size", "p_type", "p_partkey"], "p_retailprice", "p_partkey", ["linear", "ridge", "decision_tree"],
        cv_folds=5)
    return _with_failures(spark, results, failures)


@query("t3_logistic")
def t3(spark, sf):
    return _classify(spark, sf, "logistic")


@query("t3_logistic_many_classes")
def t3b(spark, sf):
    return _classify(spark, sf, "logistic", many=True)


@query("t3_logistic_stationary", """
select slot, true as flat from (values ('intercept'), ('plen'), ('user_id')) as v(slot)""")
def t3c(spark, sf):
    """At the fitted weights the gradient of the penalised loss is zero in every slot."""
    train, _, prepared = class_problem(spark, sf)
    ready = prepared.slim(train).persist()
    model = fit_model("logistic", "classification", ready, 2)
    n = ready.count()
    scored = model.transform(ready).select(
        (vector_to_array("probability")[1] - F.col("_label")).alias("gap"), vector_to_array("features").alias("x"))
    names = prepared.preprocessor.names
    weights = model.core.coefficients.toArray()
    slopes = [(F.avg(F.col("gap") * F.col("x")[i]) + F.lit(float(weights[i]) / n)).alias(c) for i, c in enumerate(names)]
    row = scored.agg(*slopes, F.avg("gap").alias("intercept"))
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("slot"), (F.abs(F.col(c)) < 1e-4).alias("flat")) for c in [*names, "intercept"]
    ])))


@query("t4_random_forest")
def t4(spark, sf):
    return _classify(spark, sf, "random_forest")


@query("t4_random_forest_regression")
def t4b(spark, sf):
    return _regress(spark, sf, "random_forest")


@query("t5_decision_tree")
def t5(spark, sf):
    return _classify(spark, sf, "decision_tree", many=True)


@query("t5_decision_tree_regression")
def t5b(spark, sf):
    return _regress(spark, sf, "decision_tree")


@query("t6_gradient_boosting")
def t6(spark, sf):
    return _classify(spark, sf, "gradient_boosting")


@query("t6_gradient_boosting_many_classes")
def t6b(spark, sf):
    return _classify(spark, sf, "gradient_boosting", many=True)


@query("t6_gradient_boosting_regression")
def t6c(spark, sf):
    return _regress(spark, sf, "gradient_boosting")


def _register_preset(name: str) -> None:
    @query(f"t7_{name}")
    def run(spark, sf):
        return _classify(spark, sf, name)


for _name in ("xgboost", "lightgbm", "catboost"):
    _register_preset(_name)


@query("t8_svm")
def t8(spark, sf):
    return _classify(spark, sf, "svm")


@query("t8_svm_regression")
def t8b(spark, sf):
    return _regress(spark, sf, "svm")


@query("t9_knn_classifier", """
with p as (select q.vec_id, d.label, row_number() over (partition by q.vec_id order by
   list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda z: (z[1]::double - z[2]::double)*(z[1]::double - z[2]::double))), d.vec_id) as place
   from embeddings q join embeddings d on q.vec_id <> d.vec_id qualify place <= 5),
 v as (select vec_id, label, count(*) as n from p group by vec_id, label)
select vec_id, label as prediction from v qualify row_number() over (partition by vec_id order by n desc, label) = 1""")
def t9(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")
    return knn_predict(vectors, vectors, "vec_id", "x", "label", 5, exclude_self=True)


@query("t9_knn_regressor", """
with p as (select q.p_partkey, d.p_retailprice as y, row_number() over (partition by q.p_partkey order by
   (q.p_size-d.p_size)*(q.p_size-d.p_size) + (q.p_partkey/100.0-d.p_partkey/100.0)*(q.p_partkey/100.0-d.p_partkey/100.0), d.p_partkey) as place
   from part q join part d on q.p_partkey <> d.p_partkey qualify place <= 4)
select p_partkey, round(avg(y), 4) as prediction from p group by p_partkey""")
def t9b(spark, sf):
    part = table(spark, sf, "part").withColumn("near", F.col("p_partkey") / 100.0)
    rows = part.select("p_partkey", feature_array(["p_size", "near"]).alias("x"), "p_retailprice")
    return rounded(knn_predict(rows, rows, "p_partkey", "x", "p_retailprice", 4, False, True), 4)


@query("t10_naive_bayes", """
with s as (select label, count(*)*1.0/(select count(*) from imb) as pr, avg(user_id) as mu, avg(plen) as mp,
  var_pop(user_id) as vu, var_pop(plen) as vp from imb group by label),
 j as (select event_id, imb.label, s.label as c, ln(pr) - 0.5*(ln(2*pi()*vu) + (user_id-mu)*(user_id-mu)/vu)
   - 0.5*(ln(2*pi()*vp) + (plen-mp)*(plen-mp)/vp) as ll from imb, s)
select event_id, cast(c as double) as prediction from j qualify row_number() over (partition by event_id order by ll desc) = 1""",
       ("imb",))
def t10(spark, sf):
    rows = view(spark, sf, "imb").select("event_id", "user_id", "plen", "label")
    prepared = T.prepare(rows, ["user_id", "plen"], "label", "event_id", "classification")
    ready = prepared.slim(rows)
    model = fit_model("naive_bayes", "classification", ready, 2)
    return model.transform(ready).select("event_id", "prediction")


TWO = """
with m as (select avg({a}) as ma, avg({b}) as mb, avg(p_retailprice) as my from part),
 s as (select sum(({a}-ma)*({a}-ma)) as aa, sum(({b}-mb)*({b}-mb)) as bb, sum(({a}-ma)*({b}-mb)) as ab,
   sum(({a}-ma)*(p_retailprice-my)) as ay, sum(({b}-mb)*(p_retailprice-my)) as by_ from part, m),
 w as (select (bb*ay - ab*by_)/(aa*bb - ab*ab) as wa, (aa*by_ - ab*ay)/(aa*bb - ab*ab) as wb from s)
"""


@query("t11_linear", TWO.format(a="p_size", b="p_partkey") + """
select p_partkey, round(my + wa*(p_size-ma) + wb*(p_partkey-mb), 4) as prediction from part, m, w""")
def t11(spark, sf):
    return _regress(spark, sf, "linear", digits=4)


@query("t12_ridge", """
with m as (select avg(p_size) as mx, avg(p_retailprice) as my from part),
 s as (select sum((p_size-mx)*(p_retailprice-my)) / (sum((p_size-mx)*(p_size-mx)) + 1.0) as w from part, m)
select p_partkey, round(my + w*(p_size-mx), 4) as prediction from part, m, s""")
def t12(spark, sf):
    return _regress(spark, sf, "ridge", features=("p_size",), digits=4)


@query("t13_lasso", """
with m as (select avg(p_size) as mx, avg(p_retailprice) as my from part),
 s as (select sum((p_size-mx)*(p_retailprice-my))/count(*) as c, sum((p_size-mx)*(p_size-mx))/count(*) as v from part, m),
 w as (select sign(c)*greatest(abs(c) - 1.0, 0.0)/v as w from s)
select p_partkey, round(my + w*(p_size-mx), 3) as prediction from part, m, w""")
def t13(spark, sf):
    return _regress(spark, sf, "lasso", features=("p_size",), digits=3)


@query("x7_polynomial", TWO.format(a="p_size", b="(p_size*p_size)") + """
select p_partkey, round(my + wa*(p_size-ma) + wb*(p_size*p_size-mb), 3) as prediction from part, m, w""")
def x7(spark, sf):
    return _regress(spark, sf, "polynomial", {"degree": 2}, ("p_size",), 3)


@query("t14_balanced_bagging")
def t14(spark, sf):
    return _classify(spark, sf, "balanced_bagging")


@query("x8_adaboost")
def x8(spark, sf):
    return _classify(spark, sf, "adaboost")


@query("t15_cv_scores")
def t15(spark, sf):
    rows = spread(view(spark, sf, "imb").select("event_id", "user_id", "plen", "label"))
    prepared = T.prepare(rows, ["user_id", "plen"], "label", "event_id", "classification", scaling="standard")
    folded = with_folds(rows, "event_id", 5, "label").persist()
    oof = T.out_of_fold("decision_tree", T.prepare_folds(prepared, folded, 5), folded)
    return rounded(fold_summary(fold_scores(oof, "classification")))


def _fold_table(spark, sf):
    """The class problem's training rows with features prepared without each fold."""
    train, _, prepared = class_problem(spark, sf)
    folded = with_folds(train, "event_id", 5, "label").persist()
    return fold_features(folded, T.prepare_folds(prepared, folded, 5))


def _points(result, spark):
    """The searched points: each has a score in [0, 1], and the chosen one has the highest, ties to the first."""
    table = result.table(spark)
    top = table.agg(F.max("score")).first()[0]
    names = [c for c in table.columns if c not in ("score", "chosen")]
    best_is_top = F.when(F.col("chosen"), F.col("score") == F.lit(top)).otherwise(F.col("score") <= F.lit(top))
    return table.select(*names, F.col("score").between(0, 1).alias("scored"), best_is_top.alias("agrees"))


@query("t16_grid_search", """
select t as "numTrees", d as "maxDepth", m as "minInstancesPerNode", true as scored, true as agrees
from (select unnest([50.0::double, 100, 200]) as t), (select unnest([30.0::double, 10, 20]) as d), (select unnest([1.0::double, 2, 5]) as m)""")
def t16(spark, sf):
    return _points(search("random_forest", "classification", _fold_table(spark, sf), 2, "grid"), spark)


@query("t17_random_search")
def t17(spark, sf):
    found = search("xgboost", "classification", _fold_table(spark, sf), 2, "random")
    return rounded(found.table(spark))


@query("t18_calibration")
def t18(spark, sf):
    train, test, prepared = class_problem(spark, sf)
    fit_part, held = train_test(train, "event_id", 0.3, "label", seed="calibration")
    model = fit_model("naive_bayes", "classification", prepared.slim(fit_part), 2)
    curve = calibrate(model.transform(prepared.slim(held)), "isotonic")
    scored = curve.transform(model.transform(prepared.slim(test)))
    return rounded(scored.select("event_id", "_label", "prediction", vector_to_array("probability")[1].alias("p1")))


@query("t18_calibration_classes", """
select cast(c as int) as class, 0 as falls, true as sums_to_one, (select count(distinct l_returnflag) from lineitem) as classes
from (select unnest(range(3)) as c)""")
def t18b(spark, sf):
    """Isotonic curves of three classes: before division by their sum no calibrated value falls as the score rises."""
    train, test, prepared = many_class_problem(spark, sf)
    fit_part, held = train_test(train, "row_key", 0.3, "l_returnflag", seed="calibration")
    classes = len(prepared.classes)
    model = fit_model("naive_bayes", "classification", prepared.slim(fit_part), classes)
    curves = calibrate(model.transform(prepared.slim(held)), "isotonic", classes)
    scored = model.transform(prepared.slim(test))
    raw = scored.select(vector_to_array("probability").alias("_raw"))
    parts = None
    for k in range(classes):
        # Equal scores share a value, so distinct pairs in order of the score tell of every fall.
        pairs = curves._curve(raw, k, k).groupBy(F.round(F.col("_raw")[k], 12).alias("x")).agg(F.min(f"_v{k}").alias("lo"), F.max(f"_v{k}").alias("hi"))
        steps = running_max(pairs, "x", "hi")
        one = steps.agg(F.count_if(F.col("lo") < F.col("before") - 1e-9).cast("int").alias("falls")).withColumn("class", F.lit(k))
        parts = one if parts is None else parts.unionByName(one)
    total = F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda a, x: a + x)
    ones = curves.transform(scored).agg(F.min(F.abs(total - 1.0) < 1e-9).alias("sums_to_one"))
    return parts.join(F.broadcast(ones)).withColumn("classes", F.lit(classes).cast("bigint"))


def _members(spark, sf):
    train, test, prepared = class_problem(spark, sf)
    even = undersample(train, "label", "event_id")
    ready = prepared.slim(even).persist()
    names = {"logistic": {}, "naive_bayes": {}, "decision_tree": {}}
    return [fit_model(n, "classification", ready, 2, None, p) for n, p in names.items()], prepared, train, test


def _vote(members, prepared, test, weights=None):
    model = N.voting(members, weights)
    scored = model.transform(prepared.slim(test))
    return rounded(scored.select("event_id", "_label", "prediction", vector_to_array("probability")[1].alias("p1")))


@query("en1_voting")
def en1(spark, sf):
    members, prepared, _, test = _members(spark, sf)
    return _vote(members, prepared, test)


@query("en2_weighted_voting")
def en2(spark, sf):
    members, prepared, _, test = _members(spark, sf)
    return _vote(members, prepared, test, [1.5, 0.5, 1.0])


@query("en1_voting_regression", TWO.format(a="p_size", b="p_partkey") + """,
 r as (select sum((p_size-ma)*(p_retailprice-my)) / sum((p_size-ma)*(p_size-ma)) as w1 from part, m)
select p_partkey, round((my + wa*(p_size-ma) + wb*(p_partkey-mb) + my + wa*(p_size-ma) + wb*(p_partkey-mb))/2, 3) as prediction from part, m, w""")
def en1b(spark, sf):
    part, prepared = number_problem(spark, sf)
    ready = prepared.slim(part).persist()
    members = [fit_model("linear", "regression", ready), fit_model("polynomial", "regression", ready, params={"degree": 1})]
    return rounded(N.voting(members).transform(ready).select("p_partkey", "prediction"), 3)


@query("en3_out_of_fold", """
with c as (select label, count(*) - cast(floor(count(*) * 0.2 + 0.5) as bigint) as n from imb group by label)
select cast(f as int) as fold, cast(label as double) as label, cast(floor(n * (f + 1) / 5) - floor(n * f / 5) as bigint) as n_rows
from c, (select unnest(range(5)) as f)""", ("imb",))
def en3b(spark, sf):
    """Every training row has base scores from one fold's models, made without it."""
    train, _, prepared = class_problem(spark, sf)
    folded = with_folds(train, "event_id", 5, "label").persist()
    ready = fold_features(folded, T.prepare_folds(prepared, folded, 5), prepared)
    scored = N.out_of_fold_scores(ready, ["naive_bayes"], "classification", 2, 5)
    scored = scored.dropDuplicates(["event_id"]).where("_meta is not null")
    return scored.groupBy("fold", F.col("_label").alias("label")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("en3_stacking")
def en3(spark, sf):
    train, test, prepared = class_problem(spark, sf)
    folded = with_folds(train, "event_id", 5, "label").persist()
    ready = fold_features(folded, T.prepare_folds(prepared, folded, 5), prepared)
    model = N.stacking(ready, ["naive_bayes", "decision_tree"], "classification", 2, "logistic", 5)
    scored = model.transform(prepared.slim(test))
    return rounded(scored.select("event_id", "_label", "prediction", vector_to_array("probability")[1].alias("p1")))
