"""Models, tuning, ensembles, explanations, packages and scoring."""

import re

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from prepmill import session
from prepmill.operators import balance, ensemble, explain, models, package, preprocess, scoring, split, training, tuning
from prepmill.session import scratch_path, spread

QUICK = {
    "random_forest": {"numTrees": 8, "maxDepth": 5}, "decision_tree": {"maxDepth": 5},
    "gradient_boosting": {"maxIter": 4}, "xgboost": {"maxIter": 3, "maxDepth": 3}, "lightgbm": {"maxIter": 3},
    "catboost": {"maxIter": 3, "maxDepth": 3}, "balanced_bagging": {"bags": 3, "maxDepth": 5},
    "adaboost": {"rounds": 4, "maxDepth": 2}, "svm": {"size": 32},
}


def blobs(spark, classes=2, n=240, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        c = i % classes
        rows.append((i, float(rng.normal(3 * c)), float(rng.normal(-2 * c)), "uvw"[int(rng.integers(3))], f"class{c}",
                     float(3 * c + rng.normal(0, 0.1))))
    return spark.createDataFrame(rows, "id long, a double, b double, t string, c string, y double").coalesce(1)


@pytest.fixture(scope="module")
def two(spark):
    train, test = split.train_test(blobs(spark), "id", 0.25, "c")
    train, test = train.persist(), test.persist()
    prepared = training.prepare(train, ["a", "b", "t"], "c", "id", scaling="standard")
    return train, test, prepared, prepared.slim(train).persist(), prepared.slim(test).persist()


@pytest.fixture(scope="module")
def numbers(spark):
    train, test = split.train_test(blobs(spark), "id", 0.25)
    prepared = training.prepare(train, ["a", "b", "t"], "y", "id", scaling="standard")
    return train, test, prepared, prepared.slim(train).persist(), prepared.slim(test).persist()


def accuracy(scored):
    return scored.agg(F.avg((F.col("_label") == F.col("prediction")).cast("double"))).first()[0]


@pytest.mark.parametrize("name", models.CLASSIFIERS)
def test_classifier_learns_and_reloads(spark, two, name):
    _, _, prepared, ready, held = two
    model = models.fit_model(name, "classification", ready, 2, None, QUICK.get(name), "id")
    model.classes = prepared.classes
    scored = model.transform(held).persist()
    assert accuracy(scored) > 0.85
    p = scored.select(vector_to_array("probability").alias("p")).collect()
    assert all(abs(sum(r["p"]) - 1) < 1e-6 for r in p)
    path = package.save_package(spark, scratch_path(spark, "t"), model, prepared.preprocessor, prepared.features, "c")
    again = package.load_package(spark, path)
    assert again.model.classes == ["class0", "class1"]
    both = scored.select("id", "prediction").join(
        again.model.transform(held).select("id", F.col("prediction").alias("p2")), "id")
    assert both.where("prediction <> p2").count() == 0 and both.count() == scored.count()


@pytest.mark.parametrize("name", ["logistic", "gradient_boosting", "svm", "knn", "naive_bayes", "adaboost", "balanced_bagging"])
def test_three_classes(spark, name):
    df = blobs(spark, 3)
    prepared = training.prepare(df, ["a", "b"], "c", "id")
    ready = prepared.slim(df).persist()
    model = models.fit_model(name, "classification", ready, 3, None, QUICK.get(name), "id")
    scored = model.transform(ready)
    assert accuracy(scored) > 0.8
    assert {len(r["p"]) for r in scored.select(vector_to_array("probability").alias("p")).collect()} == {3}


@pytest.mark.parametrize("name", models.REGRESSORS)
def test_regressor_learns_and_reloads(spark, numbers, name):
    _, _, prepared, ready, held = numbers
    model = models.fit_model(name, "regression", ready, 0, None, QUICK.get(name), "id")
    scored = model.transform(held).persist()
    facts = training.score_predictions(scored, prepared)
    # Few boosting rounds and a strong lasso penalty leave more of the spread unexplained.
    assert facts["r2"] > (0.1 if name in ("lasso", "xgboost", "lightgbm", "catboost", "gradient_boosting") else 0.5)
    path = package.save_package(spark, scratch_path(spark, "t"), model, prepared.preprocessor, prepared.features, "y")
    again = package.load_package(spark, path).model.transform(held).select("id", F.col("prediction").alias("p2"))
    worst = scored.join(again, "id").agg(F.max(F.abs(F.col("prediction") - F.col("p2")))).first()[0]
    assert worst < 1e-9


@pytest.mark.parametrize("limit", [1024, 0])
def test_ridge_matches_the_closed_form(spark, numbers, monkeypatch, limit):
    monkeypatch.setattr(models, "MAX_NORMAL_SLOTS", limit)
    _, _, _, ready, _ = numbers
    rows = ready.select("_label", vector_to_array("features").alias("a")).collect()
    x, y = np.array([r["a"] for r in rows]), np.array([r["_label"] for r in rows])
    x, y = x - x.mean(axis=0), y - y.mean()
    model = models.fit_model("ridge", "regression", ready, params={"alpha": 300.0, "tol": 1e-12})
    want = np.linalg.solve(x.T @ x + 300.0 * np.eye(x.shape[1]), x.T @ y)
    assert np.allclose(model.core.coefficients.toArray(), want, atol=1e-5)


def test_one_failure_does_not_stop_the_others(spark, two):
    train, test, *_ = two
    results, failures = training.train_models(
        train, test, ["a", "b", "t"], "c", "id", ["naive_bayes", "no_such_model", "decision_tree"], cv_folds=3,
        params=QUICK, use_class_weights=True)
    assert set(results) == {"naive_bayes", "decision_tree"} and set(failures) == {"no_such_model"}
    assert all(len(r.cv_scores) == 3 for r in results.values())
    table = {r["model"]: r for r in training.results_table(spark, results).collect()}
    assert table["naive_bayes"]["accuracy"] > 0.85 and table["naive_bayes"]["roc_auc"] > 0.9
    report = {r["model"]: r["best_params"] for r in package.comparison_report(spark, results).collect()}
    assert report["decision_tree"] == "Default"
    assert training.long_predictions(results).groupBy("model").count().count() == 2


def test_too_few_rows(spark):
    df = blobs(spark, 2, 12)
    with pytest.raises(ValueError, match="20"):
        training.train_models(df, df, ["a"], "c", "id", ["logistic"])


def test_out_of_fold_rows_are_all_unseen(spark, two):
    train, _, prepared, *_ = two
    folded = split.with_folds(train, "id", 4, "c").persist()
    counts = folded.groupBy("c", "fold").count().collect()
    assert max(r["count"] for r in counts) - min(r["count"] for r in counts) <= 1
    oof = training.out_of_fold("naive_bayes", training.prepare_folds(prepared, folded, 4), folded)
    assert oof.count() == train.count()
    seen = oof.select("id", "fold").join(folded.select("id", F.col("fold").alias("f2")), "id")
    assert seen.where("fold <> f2").count() == 0


def test_search_picks_the_better_grid_point(spark, two):
    train, _, prepared, *_ = two
    ready = prepared.apply(split.with_folds(train, "id", 3, "c")).select("_label", "features", "fold")
    best, score = tuning.search("decision_tree", "classification", ready, 2, "grid", {"maxDepth": [0, 4]}, folds=3)
    assert best == {"maxDepth": 4} and score > 0.8
    assert len(tuning.grid_points(tuning.FOREST_GRID)) == 27
    assert len(tuning.random_points(tuning.BOOST_GRID)) == 20


@pytest.mark.parametrize("method", ["isotonic", "sigmoid"])
def test_calibration_keeps_probabilities(two, method):
    _, _, _, ready, held = two
    model = models.fit_model("naive_bayes", "classification", ready, 2)
    curve = tuning.calibrate(model.transform(ready), method)
    scored = curve.transform(model.transform(held))
    assert accuracy(scored) > 0.85
    ends = scored.select(vector_to_array("probability")[1].alias("p")).agg(F.min("p"), F.max("p")).first()
    assert 0 <= ends[0] <= ends[1] <= 1


def test_voting_is_a_weighted_mean(two):
    _, _, _, ready, held = two
    members = [models.fit_model(n, "classification", ready, 2, None, QUICK.get(n)) for n in ("naive_bayes", "decision_tree")]
    p = lambda m: {r["id"]: r["p"] for r in m.transform(held).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    one, other = p(members[0]), p(members[1])
    equal, weighted = p(ensemble.voting(members)), p(ensemble.voting(members, [1.5, 0.5]))
    for i in one:
        assert equal[i] == pytest.approx((one[i] + other[i]) / 2)
        assert weighted[i] == pytest.approx(one[i] * 0.75 + other[i] * 0.25)
    with pytest.raises(ValueError):
        ensemble.voting(members, [5.0, 1.0])


@pytest.mark.parametrize("meta", ["logistic", "random_forest", "xgboost"])
def test_stacking(spark, two, meta):
    train, _, prepared, _, held = two
    folded = prepared.apply(split.with_folds(train, "id", 3, "c")).select("id", "_label", "features", "fold").persist()
    model = ensemble.stacking(folded, ["naive_bayes", "decision_tree"], "classification", 2, meta, 3, QUICK)
    assert accuracy(model.transform(held)) > 0.85
    if meta == "logistic":
        path = package.save_package(spark, scratch_path(spark, "t"), model, prepared.preprocessor, prepared.features, "c")
        assert accuracy(package.load_package(spark, path).model.transform(held)) == accuracy(model.transform(held))


def test_stacking_numbers(numbers):
    train, _, prepared, _, held = numbers
    folded = prepared.apply(split.with_folds(train, "id", 3)).select("id", "_label", "features", "fold").persist()
    model = ensemble.stacking(folded, ["linear", "decision_tree"], "regression", 0, "linear", 3, QUICK)
    assert training.score_predictions(model.transform(held), prepared)["r2"] > 0.8


def test_stacking_keeps_no_vectors_of_other_folds(spark, two, monkeypatch):
    """A task that reads a kept table reads its whole rows, so each fit's holds only what it is fitted on."""
    train, _, prepared, _, held = two
    folded = split.with_folds(train, "id", 3, "c")
    rows = tuning.fold_features(folded, training.prepare_folds(prepared, folded, 3), prepared)
    fits, fit = [], models.fit_model

    def seen(name, kind, df, *rest):
        fits.append((df.columns, df.storageLevel.useMemory, df))
        return fit(name, kind, df, *rest)

    monkeypatch.setattr(ensemble, "fit_model", seen)
    model = ensemble.stacking(rows, ["naive_bayes", "decision_tree"], "classification", 2, "logistic", 3, QUICK, "id")
    bases = [f for f in fits if "id" in f[0]]
    assert len(fits) == 9 and len(bases) == 8
    assert all(names == ["id", "_label", "features"] and kept for names, kept, _ in bases)
    assert not any(df.storageLevel.useMemory for *_, df in bases)
    assert accuracy(model.transform(held)) > 0.85


def test_stacking_query_keeps_narrow_rows(spark, sf, monkeypatch):
    """The kept rows below the folds' vectors hold none of them."""
    from prepmill.plans import training as plan

    seen = []
    monkeypatch.setattr(plan.N, "stacking", lambda rows, *a: seen.append(rows) or models.FittedModel("none", "classification", []))
    with pytest.raises(Exception, match="probability|prediction"):
        plan.en3(spark, sf)
    kept = seen[0]._jdf.queryExecution().withCachedData().toString()
    relations = [line for line in kept.splitlines() if "InMemoryRelation" in line]
    assert relations and not any("features" in line for line in relations)


def test_shapley_values_add_up(two):
    _, _, prepared, ready, held = two
    model = models.fit_model("random_forest", "classification", ready, 2, None, QUICK["random_forest"])
    names = prepared.preprocessor.names
    rows, behind = 7, 4
    values = explain.shapley_values(model, held, names, "id", rows, behind, 6).collect()
    assert len(values) == rows * len(names)
    from prepmill.operators.view import sample
    out = explain.output_column("classification")
    mean = model.transform(sample(held, behind, "id", "42:background")).agg(F.avg(out)).first()[0]
    f = {r["id"]: r["f"] for r in model.transform(held).select("id", out.alias("f")).collect()}
    sums = {}
    for r in values:
        sums[r["id"]] = sums.get(r["id"], 0) + r["attribution"]
    for i, s in sums.items():
        assert s == pytest.approx(f[i] - mean, abs=1e-9)


def test_permutation_importance_ignores_noise(two):
    _, _, prepared, ready, held = two
    model = models.fit_model("decision_tree", "classification", ready, 2, None, {"maxDepth": 3})
    names = prepared.preprocessor.names
    got = {r["feature"]: r for r in explain.permutation_importance(model, held, names, "id", 4, block_rows=25).collect()}
    assert got["a"]["importance"] > 0.05
    used = {names[i] for i, w in enumerate(model.core.featureImportances.toArray()) if w > 0}
    for n in set(names) - used:
        assert got[n]["importance"] == 0 and got[n]["std"] == 0


def test_permutation_importance_is_one_ring_for_all_sizes(numbers):
    """Blocks only divide the work: importances are those of one ring."""
    _, _, prepared, ready, held = numbers
    model = models.fit_model("linear", "regression", ready)
    names = prepared.preprocessor.names
    one, many = (
        {r["feature"]: (r["importance"], r["std"]) for r in explain.permutation_importance(
            model, held, names, "id", 3, block_rows=size).collect()} for size in (50_000, 4))
    assert one.keys() == many.keys()
    for n in one:
        assert many[n] == pytest.approx(one[n], abs=1e-9)


def test_importance_tables(spark, two):
    _, _, prepared, ready, held = two
    names = prepared.preprocessor.names
    forest = models.fit_model("random_forest", "classification", ready, 2, None, QUICK["random_forest"])
    table = explain.feature_importance(spark, forest, names)
    assert table.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    told = explain.explain_predictions(table, held, names, "id", 2)
    assert told.count() == 2 * held.count()
    linear = models.fit_model("logistic", "classification", ready, 2)
    assert explain.coefficients(spark, linear, names).first()["feature"] in ("a", "b")


def test_score_a_table(two):
    train, test, prepared, ready, _ = two
    model = models.fit_model("naive_bayes", "classification", ready, 2)
    scored = model.transform(prepared.apply(test.drop("c"), labelled=False))
    out = scoring.with_confidence(scoring.predicted_columns(scored, prepared.classes, ["id"]), ["Prob_class0", "Prob_class1"])
    assert out.columns == ["id", "Predicted", "Prob_class0", "Prob_class1", "Confidence", "Confidence_Level"]
    assert {r[0] for r in out.select("Predicted").distinct().collect()} <= {"class0", "class1"}
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_confidence_levels_close_on_the_right(spark):
    df = spark.createDataFrame([(0.6,), (0.61,), (0.8,), (0.81,), (1.0,)], "p double")
    got = [r["Confidence_Level"] for r in scoring.with_confidence(df, ["p"]).collect()]
    assert got == ["Low", "Medium", "Medium", "High", "High"]


def test_preprocessor_handles_unseen_and_missing(spark):
    train = spark.createDataFrame([(1.0, "a", 1.0), (3.0, "b", 2.0), (None, "b", 3.0), (5.0, None, 9.0)], "n double, t string, y double")
    new = spark.createDataFrame([(None, "zz"), (1.0, None), (2.0, "it's \\ odd")], "n double, t string")
    for encoding, width in (("onehot", 2), ("ordinal", 2), ("target", 2)):
        p = preprocess.fit_preprocessor(train, ["n", "t"], "median", "minmax", encoding, "y")
        rows = preprocess.transformed_preview(new, p, []).collect()
        assert len(p.names) == width
        assert rows[0][0] == 0.5  # the median 3 on the scale 1..5
        if encoding == "ordinal":
            assert [r[1] for r in rows] == [-1.0, 1.0, -1.0]
        if encoding == "onehot":
            assert [r[1] for r in rows] == [0.0, 1.0, 0.0]
        if encoding == "target":
            assert rows[0][1] == pytest.approx(3.75)


def test_scaling_constants(spark):
    df = spark.createDataFrame([(0.1, 1.0), (0.1, 2.0), (0.1, 4.0)], "c double, v double")
    for method in ("standard", "minmax", "robust"):
        assert {r["c"] for r in preprocess.scale(df, ["c"], method).collect()} == {0.0}


def test_search_queries_use_the_whole_grids(spark, sf, monkeypatch):
    """t16 and t17 search the operator's own points, in its own number."""
    from prepmill.operators import tuning
    from prepmill.plans import training as plans

    tried = []

    def record(name, kind, data, classes, points, *rest):
        tried.append(points)
        return [[0.0] * 5 for _ in points]

    monkeypatch.setattr(tuning, "_fitted_scores", record)
    monkeypatch.setattr(tuning, "_boosted_scores", record)
    plans.t16(spark, sf).collect()
    plans.t17(spark, sf).collect()
    assert tried[0] == tuning.grid_points(tuning.FOREST_GRID) and len(tried[0]) == 27
    assert tried[1] == tuning.random_points(tuning.BOOST_GRID) and len(tried[1]) == 20


def forest_guesses(model, held):
    return {r["id"]: r["prediction"] for r in model.transform(held).select("id", "prediction").collect()}


def test_staged_forests_are_their_parts(spark, two):
    """All trees at full depth guess as Spark's own forest; cut at depth 0 a tree knows only its root."""
    from prepmill.operators.staged import staged_predictions, tree_nodes

    _, _, _, ready, held = two
    fitted = models.fit_model("random_forest", "classification", ready, 2, None, {"numTrees": 9, "maxDepth": 6})
    stages = [(9, 6), (4, 6), (9, 0), (9, 30)]
    got = staged_predictions(fitted.core, True, held.select("features", F.col("id").alias("_label")), stages)
    rows = {}
    for r in got.collect():
        rows.setdefault(int(r["model"]), {})[int(r["label"])] = r["prediction"]
    whole = forest_guesses(fitted, held)
    assert rows[0] == whole and rows[3] == whole
    nodes = tree_nodes(fitted.core, True)
    root = nodes.value[nodes.roots].sum(axis=0).argmax()
    assert set(rows[2].values()) == {float(root)}
    first = [t for t in fitted.core.trees[:4]]
    votes = {}
    for t in first:
        for r in t.transform(held).select("id", vector_to_array("probability").alias("p")).collect():
            votes[r["id"]] = votes.get(r["id"], 0) + np.array(r["p"])
    assert rows[1] == {i: float(v.argmax()) for i, v in votes.items()}


def test_boosted_search_learns_by_rounds(spark, two, numbers):
    """Scores of ensembles grown side by side: with more rounds a slow learner catches up; classes, numbers, weights."""
    from prepmill.operators.boosting import BoostedSearch

    train, _, prepared, *_ = two
    ready = prepared.apply(split.with_folds(train, "id", 3, "c")).select("_label", "features", "fold").repartition(3)
    found = BoostedSearch(ready, 3, 2).run([(2, 0.3, 10), (2, 0.3, 1), (3, 0.05, 5)])
    assert len(found) == 3 and all(len(s) == 3 for s in found.values())
    assert np.mean(found[2, 0.3, 10]) > 0.9
    train, _, prepared, *_ = numbers
    folded = split.with_folds(train, "id", 3)
    ready = training.fold_features(folded, training.prepare_folds(prepared, folded, 3))
    assert {"features_0", "features_2"} <= set(ready.columns)
    found = BoostedSearch(ready, 3, 0).run([(3, 0.2, 2), (3, 0.2, 12)])
    assert np.mean(found[3, 0.2, 12]) > max(0.8, np.mean(found[3, 0.2, 2]))
    many = blobs(spark, 3)
    prepared = training.prepare(many, ["a", "b"], "c", "id")
    ready = prepared.apply(split.with_folds(many, "id", 3, "c")).select("_label", "features", "fold")
    assert np.mean(BoostedSearch(ready, 3, 3).run([(3, 0.3, 8)])[3, 0.3, 8]) > 0.85


def test_boosted_trees_are_those_of_a_plain_learner(spark, monkeypatch):
    """Margins after some rounds equal a learner that tries every cut of every node."""
    from prepmill.operators import boosting
    from prepmill.operators.boosting import BoostedSearch

    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (90, 2)).astype(float)
    y = ((x[:, 0] > 5) ^ (x[:, 1] > 7)).astype(float)
    rows = [(i, float(a), float(b), float(c), i % 3) for i, ((a, b), c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, _label double, fold int")
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)

    def tree(rows, goal, depth):
        mean = goal[rows].mean()
        best = None
        for s in range(2):
            for cut in range(12):
                left, right = rows[x[rows, s] <= cut], rows[x[rows, s] > cut]
                if len(left) and len(right):
                    gain = goal[left].sum() ** 2 / len(left) + goal[right].sum() ** 2 / len(right) - goal[rows].sum() ** 2 / len(rows)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, s, cut, left, right)
        if not depth or best is None:
            return lambda v: mean
        _, s, cut, left, right = best
        low, high = tree(left, goal, depth - 1), tree(right, goal, depth - 1)
        return lambda v: low(v) if v[s] <= cut else high(v)

    def score(fold, rounds, step, depth):
        sign = 2 * y - 1
        inside = np.array([i for i in range(90) if i % 3 != fold])
        margin = np.zeros(90)
        for r in range(rounds):
            goal = sign if r == 0 else 4 * sign / (1 + np.exp(2 * sign * margin))
            t = tree(inside, goal, depth)
            margin += (1.0 if r == 0 else step) * np.array([t(v) for v in x])
        held = [i for i in range(90) if i % 3 == fold]
        guess = margin[held] > 0
        truth = y[held] > 0
        f1 = [2 * ((guess == c) & (truth == c)).sum() / max((guess == c).sum() + (truth == c).sum(), 1) for c in (False, True)]
        share = [(truth == c).mean() for c in (False, True)]
        return sum(a * b for a, b in zip(f1, share))

    points = [(2, 0.3, 1), (2, 0.3, 4), (3, 0.3, 4)]
    found = BoostedSearch(ready, 3, 2).run(points)
    assert set(found) == set(points)
    for (depth, step, rounds), scores in found.items():
        assert scores == pytest.approx([score(f, rounds, step, depth) for f in range(3)])
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 20)  # several blocks, several pieces of sums, checkpoints
    monkeypatch.setattr(boosting, "MAX_CELLS", 600)
    monkeypatch.setattr(boosting, "CHECKPOINT_EVERY", 2)
    for limit in (32, 1):
        monkeypatch.setattr(boosting, "FLAT_PARTITIONS", limit)
        apart = BoostedSearch(ready.repartition(3), 3, 2).run(points)
        assert {k: pytest.approx(v) for k, v in found.items()} == apart


def test_side_tables_of_any_size(spark, monkeypatch):
    """More categories than columns could have; broadcast or shuffled; saved and loaded; unseen ones."""
    from prepmill.operators import encoders

    df = spark.range(12_000).selectExpr("id", "concat('c', id) as t", "cast(id % 7 as double) as y")
    new = spark.createDataFrame([(1, "c3"), (2, "nobody"), (3, None)], "id long, t string")
    results = []
    monkeypatch.setattr(encoders, "MAX_BROADCAST_ROWS", encoders.MAX_BROADCAST_ROWS)
    auto = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(auto)
    spark.conf.set(auto, "-1")
    for limit in (encoders.MAX_BROADCAST_ROWS, 10):
        monkeypatch.setattr(encoders, "MAX_BROADCAST_ROWS", limit)
        hot = preprocess.fit_preprocessor(df, ["t"])
        assert len(hot.names) == 11_999
        v = F.unwrap_udt("features")
        rows = hot.model.transform(new).select("id", v["size"].alias("n"), v["indices"].alias("i")).collect()
        results.append(sorted((r["id"], r["n"], list(r["i"] or [])) for r in rows))
        plan = hot.model.transform(df)._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) == (limit > 10)
    spark.conf.set(auto, was)
    assert results[0] == results[1] and [len(r[2]) for r in results[0]] == [1, 0, 0]
    path = scratch_path(spark, "side")
    coded = preprocess.fit_preprocessor(df, ["t"], encoding="target", target="y")
    coded.model.write().save(path)
    from pyspark.ml import PipelineModel

    value = lambda m: {r["id"]: r["v"] for r in m.transform(new).select("id", vector_to_array("features")[0].alias("v")).collect()}
    assert value(PipelineModel.load(path)) == value(coded.model)


def test_cross_fitted_means_leave_their_fold_out(spark):
    """Means by subtraction equal those fitted on the other folds; a key's means teach nothing about its own row."""
    from prepmill.operators import encoders

    rng = np.random.default_rng(8)
    rows = [(i, f"k{i}", "xyz"[i % 3] if i % 5 else None, float(rng.integers(0, 2)), i % 4) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k string, t string, y double, fold int")
    sums = encoders.target_sums(df, ["k", "t"], "y", 0, "fold")
    for fold in range(4):
        table, priors = encoders.target_table(sums, "t", "x", fold)
        other = df.where(F.col("fold") != fold)
        plain = preprocess.target_means(other.fillna("x", ["t"]), "t", "y")
        want = {r["category"]: r["encoded"] for r in plain.collect()}
        assert {r["category"]: r["value"][0] for r in table.collect()} == pytest.approx(want)
        assert priors == pytest.approx([other.agg(F.avg("y")).first()[0]])
    prepared = training.prepare(df, ["k"], "y", "id", "classification", encoding="target")
    folds = training.prepare_folds(prepared, df, 4)
    ready = training.fold_features(df, folds, prepared)
    found = tuning.search("decision_tree", "classification", ready, 2, "grid", {"maxDepth": [1, 3]}, folds=4)
    leaky = tuning.search("decision_tree", "classification", ready.select("id", "fold", "_label", "features"), 2, "grid", {"maxDepth": [3]}, folds=4)
    assert found.score < 0.6 < leaky.score


def test_target_means_of_several_classes(spark):
    df = blobs(spark, 3)
    prepared = training.prepare(df, ["a", "t"], "c", "id", encoding="target")
    assert prepared.preprocessor.names == ["a", "t=0", "t=1", "t=2"]
    row = prepared.slim(df).select(vector_to_array("features").alias("v")).first()
    assert sum(row["v"][1:]) == pytest.approx(1.0)


def test_resampling_stays_inside_fits(spark):
    """Every method balances what a model is fitted on; scored rows, folds and their number stay as they were."""
    rng = np.random.default_rng(6)
    rows = [(i, float(rng.normal(i % 6 == 0)), float(rng.normal()), "yes" if i % 6 == 0 else "no") for i in range(150)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c string").coalesce(1)
    train, test = split.train_test(df, "id", 0.2, "c")
    prepared = training.prepare(train, ["a", "b"], "c", "id")
    ready = prepared.slim(train).persist()
    for method in ("smote", "oversample", "undersample"):
        grown = balance.resample_prepared(ready, method, "id")
        counts = {r["_label"]: r["count"] for r in grown.groupBy("_label").count().collect()}
        assert counts[0.0] == counts[1.0] and grown.columns[:2] == ["id", "_label"]
        assert grown.select("id").distinct().count() == sum(counts.values())
    results, failures = training.train_models(
        train, test, ["a", "b"], "c", "id", ["naive_bayes", "nothing"], cv_folds=3, resample="smote", calibration="isotonic")
    assert list(failures) == ["nothing"] and results["naive_bayes"].predictions.count() == test.count()
    assert len(results["naive_bayes"].cv_scores) == 3
    told = {r["model"]: r["failed"] for r in training.failures_table(spark, results, failures).collect()}
    assert told == {"naive_bayes": False, "nothing": True}
    weighted = training.prepare(train, ["a", "b"], "c", "id", use_positive_weight=True)
    n = {r["c"]: r["count"] for r in train.groupBy("c").count().collect()}
    assert weighted.weights == {"no": 1.0, "yes": pytest.approx(n["no"] / n["yes"])}
    with pytest.raises(ValueError, match="not both"):
        training.train_models(train, test, ["a", "b"], "c", "id", ["naive_bayes"], resample="smote", use_positive_weight=True)


def test_calibration_of_several_classes(spark):
    df = blobs(spark, 3)
    prepared = training.prepare(df, ["a", "b"], "c", "id")
    ready = prepared.slim(df).persist()
    model = models.fit_model("naive_bayes", "classification", ready, 3)
    curves = tuning.calibrate(model.transform(ready), "sigmoid", 3)
    model.stages.append(curves)
    path = package.save_package(spark, scratch_path(spark, "t"), model, prepared.preprocessor, ["a", "b"], "c")
    again = package.load_package(spark, path).model
    both = [
        {r["id"]: list(r["p"]) for r in m.transform(ready).select("id", vector_to_array("probability").alias("p")).collect()}
        for m in (model, again)
    ]
    assert both[0] == both[1] and all(abs(sum(p) - 1) < 1e-9 and len(p) == 3 for p in both[0].values())
    assert accuracy(model.transform(ready)) > 0.85


def test_epsilon_fit_reaches_known_optima(spark):
    """Points on a line have a fit without loss; else no nearby line has a lower loss, and C and epsilon act."""
    from pyspark.ml.feature import VectorAssembler

    from prepmill.operators import kernel

    def fit(rows, **options):
        df = spark.createDataFrame(rows, "a double, _label double").repartition(2)
        return kernel.fit_epsilon(VectorAssembler(inputCols=["a"], outputCol="v").transform(df), "v", **options)

    line = [(float(i), 3.0 * i - 5.0) for i in range(30)]
    w, b = fit(line, C=1e6, epsilon=0.0)
    assert w[0] == pytest.approx(3.0, abs=1e-3) and b == pytest.approx(-5.0, abs=1e-2)
    assert abs(fit(line, C=1e-9, epsilon=0.1)[0][0]) < 0.01
    rng = np.random.default_rng(1)
    noisy = [(float(x), float(2 * x + rng.standard_t(2))) for x in rng.normal(size=120)]
    for rows, C, epsilon in ((noisy, 1.0, 0.5), (noisy, 0.01, 0.0), (line, 1.0, 10.0)):
        w, b = fit(rows, C=C, epsilon=epsilon)
        x, y = np.array(rows).T
        loss = lambda w, b: 0.5 * w * w + C * np.maximum(0, np.abs(y - w * x - b) - epsilon).sum()
        here = loss(w[0], b)
        grid = [(w[0] + i * d, b + j * d) for d in (0.003, 0.03, 0.3) for i in range(-3, 4) for j in range(-3, 4)]
        assert here <= min(loss(*g) for g in grid) + 2e-3 * max(here, 1.0)


def test_landmarks_carry_the_kernel(spark):
    from prepmill.operators import kernel

    rng = np.random.default_rng(2)
    points = rng.normal(size=(40, 3))
    made = kernel.LandmarkMap(points, 0.4)
    mapped = made.kernel(points) @ made.root
    assert np.allclose(mapped @ mapped.T, made.kernel(points), atol=1e-6)


def test_a_table_in_one_split_is_spread_by_its_rows(spark):
    """Only a table with rows for several tasks is moved."""
    assert spread(spark.range(0, 100, 1, 1), 30).rdd.getNumPartitions() == 3
    assert spread(spark.range(0, 40, 1, 1), 30).rdd.getNumPartitions() == 1
    assert spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_rows_in_one_of_many_splits_are_spread(spark, monkeypatch):
    """A file may have as many splits as there are cores and all its rows in one; a large table gets more splits than cores."""
    most = lambda df: max(map(len, df.rdd.glom().collect()))
    cores = spark.sparkContext.defaultParallelism
    hollow = spark.range(0, 4000 * (cores + 1), 1, cores + 1).where(F.col("id") >= 4000 * cores)
    assert hollow.rdd.getNumPartitions() > cores and most(hollow) == 4000
    assert most(spread(hollow)) <= 1000 and spread(hollow).count() == 4000
    even = spark.range(0, 4000, 1, cores)
    assert spread(even) is even
    monkeypatch.setattr(session, "SPLIT_ROWS", 100)
    assert spread(even).rdd.getNumPartitions() == 40


def test_deep_forests_keep_the_nodes_of_rows(two, numbers):
    """Trees are not sent to every task in every pass."""
    for kind, ready, classes in (("classification", two[3], 2), ("regression", numbers[3], 0)):
        core = models.fit_model("random_forest", kind, ready, classes, None, {"numTrees": 2, "maxDepth": 3}, "id").core
        assert core.getOrDefault("cacheNodeIds")


def test_boosted_search_counts_rows_of_equal_bins_once(spark, monkeypatch):
    """Far more rows than a block has, of few different bins: one block, with the scores of the rows themselves."""
    from prepmill.operators import boosting
    from prepmill.operators.boosting import BoostedSearch

    rng = np.random.default_rng(4)
    x = rng.integers(0, 4, (600, 2))
    rows = [(i % 3, float(rng.random() < (0.2 + 0.15 * a)), [float(a), float(b)], float(1 + i % 2)) for i, (a, b) in enumerate(x)]
    data = spark.createDataFrame(rows, "fold int, _label double, x array<double>, w double")
    data = data.select("fold", "_label", "w", array_to_vector("x").alias("features"))
    edges = boosting.bin_edges(data, 3)
    cells = boosting._cells(data, 3, "w", edges)
    facts = cells.agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("n"), F.sum("weight").alias("w")).first()
    assert facts["cells"] <= 4 * 4 * 2 * 3 and facts["n"] == 600 and facts["w"] == 900.0
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 96)
    monkeypatch.setattr(BoostedSearch, "_many_blocks", lambda *a: pytest.fail("more than one block"))
    found = BoostedSearch(data, 3, 2, "w").run([(3, 0.3, 6), (2, 0.1, 3)])

    # The same rows, each a cell of its own.
    monkeypatch.setattr(boosting, "_cells", lambda *a, f=boosting._cells: f(*a).select(
        "key", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"), (F.col("weight") / F.col("n")).alias("mean")
    ).select("key", F.col("mean").alias("weight"), F.lit(1).cast("bigint").alias("n")))
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 1000)
    whole = BoostedSearch(data, 3, 2, "w").run([(3, 0.3, 6), (2, 0.1, 3)])
    for point, scores in found.items():
        assert np.allclose(scores, whole[point], atol=1e-9)


def test_eliminated_features_are_fitted_on_spread_rows(spark, monkeypatch, tmp_path):
    """A file of one row group is fitted in several tasks."""
    from prepmill.plans import features as plan

    rows = spark.range(0, 600, 1, 1)
    made = [(F.col("id") % k).cast("double").alias(c) for k, c in ((7, "l_quantity"), (5, "l_discount"), (3, "l_tax"), (4, "l_linenumber"))]
    rows.select(*made, (F.col("id") % 7 > 3).cast("string").alias("l_returnflag")).write.parquet(f"{tmp_path}/lineitem.parquet")
    seen = []
    monkeypatch.setattr(plan, "ROWS_PER_SPLIT", 100)
    monkeypatch.setattr(plan.X, "eliminate_features", lambda df, *a: seen.append(df))
    plan.f6(spark, str(tmp_path))
    assert seen[0].rdd.getNumPartitions() == 6 and seen[0].count() == 600


def test_large_tables_are_fitted_on_their_different_rows(spark, monkeypatch):
    """Rows of equal bins and label as one with their weight give the scores of all rows, and few rows reach the fit."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(3000):
        a, b = float(rng.integers(0, 9)), float(rng.choice(3, p=[0.98, 0.012, 0.008]))
        rows.append((i, float(rng.random() < 1 / (1 + np.exp(3 - a + b))), float(1 + i % 2), [a, b]))
    data = spark.createDataFrame(rows, "id long, _label double, w double, x array<double>")
    data = data.select("id", "_label", "w", array_to_vector("x").alias("features")).persist()
    fits = []
    merged_rows = models._merged
    monkeypatch.setattr(models, "_merged", lambda *a: fits.append(merged_rows(*a)) or fits[-1])

    def scores(name, weight, classes=2):
        params = {"maxIter": 6} if name != "logistic" else None
        scored = models.fit_model(name, "classification", data, classes, weight, params).transform(data)
        return np.array([r["p"][1] for r in scored.select("id", vector_to_array("probability").alias("p")).orderBy("id").collect()])

    for name, weight in (("logistic", None), ("logistic", "w"), ("gradient_boosting", None), ("xgboost", "w")):
        plain = scores(name, weight)
        with monkeypatch.context() as m:
            m.setattr(models, "MERGE_ROWS", 100)
            fits.clear()
            merged = scores(name, weight)
        assert np.abs(plain - merged).max() < 1e-6, (name, weight)
        assert fits[0].count() <= 9 * 3 * 2
        assert fits[0].agg(F.sum("_merged")).first()[0] == (4500 if weight else 3000)
    monkeypatch.setattr(models, "MERGE_ROWS", 100)
    binned = models.Binned.fit(data)
    assert [list(e) for e in binned.edges] == [list(map(float, range(8))), [0.0, 1.0]]  # rare values are cut apart too
    # Rows that all differ are fitted as they are.
    assert merged_rows(data.select("_label", array_to_vector(F.array("id")).alias("features")), "features", None, 3000) is None
    facts = package._save_stage(spark, binned, "unused")
    again = package._load_stage(spark, "", "", facts).transform(data)
    slots = lambda df: [r["_binned"] for r in df.orderBy("id").collect()]
    assert slots(again) == slots(binned.transform(data))
    data.unpersist()


def test_large_tables_grow_forests_on_cells(spark, monkeypatch):
    """Without drawing, a tree of cells is Spark's tree of the rows; forests of cells score as Spark's forests and keep nothing for a row and tree."""
    from prepmill.operators import forests
    from prepmill.operators.staged import staged_predictions, tree_nodes

    rng = np.random.default_rng(3)
    rows = []
    for i in range(2000):
        x = [float(rng.integers(0, 50)), float(rng.integers(0, 9)), float(rng.integers(0, 2))]
        low = rng.random() < 1 / (1 + np.exp(3 - x[0] / 8 + x[1] / 2 - x[2]))
        rows.append((i, float(int(low) + int(rng.random() < 0.3 * x[2])), float(1 + i % 2), x))
    data = spark.createDataFrame(rows, "id long, _label double, w double, x array<double>")
    data = data.select("id", "_label", "w", array_to_vector("x").alias("features")).persist()
    edges = models.Binned.fit(data).edges
    assert [len(e) for e in edges] == [len(set(e)) for e in edges] and len(edges[0]) <= 31 and list(edges[2]) == [0.0]

    class Whole:  # draws each row once, and every slot
        poisson = staticmethod(lambda n: n)

    binned = models.Binned(edges, "bins").transform(data)
    for weight, depth, least in ((None, 4, 1), ("w", 30, 1), ("w", 30, 15), (None, 0, 1)):
        cells = forests.table_cells(data, edges, weight, 3)
        assert cells.rows.sum() == 2000 and len(cells.rows) < 2000
        tree = forests.grow_tree(cells, [len(e) + 1 for e in edges], depth, least, 3, Whole())
        options = {"weightCol": weight} if weight else {}
        plain = models.DecisionTreeClassifier(
            featuresCol="bins", labelCol="_label", maxDepth=depth, minInstancesPerNode=least, **options).fit(binned)
        mine, its = np.bincount(tree.slot + 1, minlength=4), tree_nodes(plain, True)
        assert len(tree.slot) == plain.numNodes
        assert np.array_equal(mine, np.bincount(np.where(its.left >= 0, its.feature, -1) + 1, minlength=4))
        shares = tree.stats / tree.stats.sum(axis=1, keepdims=True)
        assert np.allclose(np.sort(shares[tree.slot < 0], axis=0), np.sort(its.value[its.left < 0], axis=0))

    probabilities = lambda m, rows=data: np.array([r["p"] for r in m.transform(rows).select(
        "id", vector_to_array("probability").alias("p")).orderBy("id").collect()])
    params = {"numTrees": 60, "minInstancesPerNode": 2}
    # Spark cuts a slot of many values at other values, so its forests get the bins.
    binned = binned.select("id", "_label", "w", F.col("bins").alias("features"))
    plain, other = (models.fit_model("random_forest", "classification", binned, 3, "w", params, seed=k) for k in (42, 7))
    plain_p, other_p = (probabilities(m, binned) for m in (plain, other))
    with monkeypatch.context() as m:
        m.setattr(models, "MERGE_ROWS", 100)
        m.setattr(models, "RandomForestClassifier", lambda **_: pytest.fail("a count and a node for each row and tree"))
        mine = models.fit_model("random_forest", "classification", data, 3, "w", params)
        again = models.fit_model("random_forest", "classification", data.repartition(3), 3, "w", params)
    mine_p = probabilities(mine)
    assert np.abs(plain_p - mine_p).mean() < 1.3 * np.abs(plain_p - other_p).mean()
    assert np.array_equal(mine_p, probabilities(again))  # whatever the partitions
    assert np.abs(plain.importances() - mine.importances()).max() < 0.05
    assert len(mine.core.trees) == 60 and mine.core.getMaxDepth() == models.FOREST_DEPTH and mine.core.numClasses == 3
    held = data.select("features", F.col("id").cast("double").alias("_label"))
    got = staged_predictions(mine.core, True, held, [(60, 30), (5, 0)]).where("model = '0'").orderBy("label").collect()
    assert [r["prediction"] for r in got] == [float(p.argmax()) for p in mine_p]
    monkeypatch.setattr(forests, "MAX_CELLS", 10)  # too many cells: Spark's forest
    monkeypatch.setattr(models, "MERGE_ROWS", 100)
    wide = models.fit_model("random_forest", "classification", binned, 3, "w", params)
    assert np.array_equal(probabilities(wide, binned), plain_p)
    data.unpersist()


def test_few_passes_need_even_splits_only(spark, monkeypatch):
    """A table that is read a few times is not shuffled for the number of its rows."""
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(session, "SPLIT_ROWS", 100)
    even = spark.range(0, 4000, 1, cores)
    assert spread(even, passes=False) is even and spread(even).rdd.getNumPartitions() == 40
    assert spread(spark.range(0, 4000, 1, 1), passes=False).rdd.getNumPartitions() >= cores


def test_forest_queries_fit_rows_without_key(spark, sf, monkeypatch):
    """The kept training rows of the explained forest hold no row key; explained rows have theirs."""
    from prepmill.plans import explaining as plan

    seen = []
    monkeypatch.setattr(plan, "fit_model", lambda name, kind, rows, *a: seen.append(rows))
    _, test, _ = plan._forest(spark, sf)
    assert seen[0].columns == ["_label", "features"] and "row_key" in test.columns
    kept = re.findall(r"InMemoryRelation \[([^]]*)]", seen[0]._jdf.queryExecution().optimizedPlan().toString())
    assert kept and all("l_quantity" in k and "row_key" not in k for k in kept)
