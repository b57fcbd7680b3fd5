"""Exact neighbours and class balancing against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepmill.operators import balance, neighbors


def brute(points, ids, queries, qids, k, skip_self):
    out = {}
    for q, qid in zip(queries, qids):
        d = ((points - q) ** 2).sum(axis=1)
        order = sorted(range(len(ids)), key=lambda i: (d[i], ids[i]))
        if skip_self:
            order = [i for i in order if ids[i] != qid]
        out[qid] = [ids[i] for i in order[:k]]
    return out


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("skip_self", [False, True])
def test_neighbours_are_exact(spark, monkeypatch, small, skip_self):
    if small:
        monkeypatch.setattr(neighbors, "ROWS_PER_CELL", 20)
        monkeypatch.setattr(neighbors, "DATA_BLOCK", 15)
        monkeypatch.setattr(neighbors, "QUERY_BLOCK", 10)
        monkeypatch.setattr(neighbors, "SLICE", 4)
    rng = np.random.default_rng(3)
    points = np.round(rng.normal(size=(240, 3)), 1)
    points[:80] = points[0]  # a third of the rows are copies of one point
    rows = [(int(i), [float(x) for x in p]) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "id long, x array<double>").repartition(4)
    near = neighbors.nearest(df, df, "id", "id", "x", 5, skip_self).collect()
    got = {}
    for r in sorted(near, key=lambda r: (r["id"], r["place"])):
        got.setdefault(r["id"], []).append(r["neighbor_id"])
    ids = list(range(len(points)))
    assert got == brute(points, ids, points, ids, 5, skip_self)


def test_fewer_rows_than_neighbours(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id long, x array<double>")
    assert neighbors.nearest(df, df, "id", "id", "x", 5, True).count() == 2


@pytest.fixture(scope="module")
def uneven(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.normal()), float(rng.normal()), "big") for i in range(90)]
    rows += [(100 + i, float(rng.normal(2)), float(rng.normal(2)), "small") for i in range(20)]
    rows += [(200 + i, float(rng.normal(-3)), float(rng.normal(1)), "tiny") for i in range(7)]
    return spark.createDataFrame(rows, "id long, a double, b double, c string").persist()


def sizes(df, c="c"):
    return {r[c]: r["count"] for r in df.groupBy(c).count().collect()}


def test_smote_balances_and_stays_between_parents(spark, uneven):
    out = balance.smote(uneven, "c", ["a", "b"], "id").persist()
    assert sizes(out) == {"big": 90, "small": 90, "tiny": 90}
    where = {r["id"]: (r["a"], r["b"], r["c"]) for r in uneven.collect()}
    for r in out.where("copy > 0").collect():
        p, q = where[r["id"]], where[r["neighbor_id"]]
        assert p[2] == q[2] == r["c"]
        for i, f in enumerate(("a", "b")):
            assert min(p[i], q[i]) - 1e-9 <= r[f] <= max(p[i], q[i]) + 1e-9


def test_adasyn_prefers_hard_rows(uneven):
    out = balance.adasyn(uneven, "c", ["a", "b"], "id")
    got = sizes(out)
    assert got["big"] == 90 and abs(got["small"] - 90) <= 10


def test_smote_tomek_leaves_no_link(spark, uneven):
    out = balance.smote_tomek(uneven, "c", ["a", "b"], "id").withColumn(
        "row", F.concat_ws(":", "id", "copy")).persist()
    grown = balance.smote(uneven, "c", ["a", "b"], "id").withColumn("row", F.concat_ws(":", "id", "copy"))
    rows = grown.collect()
    points = np.array([[r["a"], r["b"]] for r in rows])
    names = [r["row"] for r in rows]
    near = brute(points, names, points, names, 1, True)
    cls = {r["row"]: r["c"] for r in rows}
    gone = {n for n in names if near[near[n][0]][0] == n and cls[n] != cls[near[n][0]]}
    assert {r["row"] for r in out.collect()} == set(names) - gone


def test_under_and_oversampling(uneven):
    assert set(sizes(balance.undersample(uneven, "c", "id")).values()) == {7}
    assert set(sizes(balance.oversample(uneven, "c", "id")).values()) == {90}


def test_weights(spark, uneven):
    weights = balance.class_weights(uneven, "c")
    assert weights["big"] == pytest.approx(117 / (3 * 90))
    total = balance.with_class_weights(uneven, "c").agg(F.sum("weight")).first()[0]
    assert total == pytest.approx(117)
    with pytest.raises(ValueError):
        balance.with_positive_weight(uneven, "c")


def test_resample_by_name(uneven):
    assert sizes(balance.resample(uneven, "c", "undersample", ["a", "b"], "id")) == {"big": 7, "small": 7, "tiny": 7}
    with pytest.raises(ValueError):
        balance.resample(uneven, "c", "other", ["a"], "id")


def test_copies_are_made_in_chunks(spark, uneven, monkeypatch):
    """Few rows against many: no array holds all copies of a row, and nothing is joined after they are made."""
    whole = {(r["id"], r["copy"]): tuple(r) for r in balance.smote(uneven, "c", ["a", "b"], "id").collect()}
    many = {(r["id"], r["copy"]) for r in balance.oversample(uneven, "c", "id").collect()}
    monkeypatch.setattr(balance, "COPY_CHUNK", 3)
    made = balance.smote(uneven, "c", ["a", "b"], "id")
    assert {(r["id"], r["copy"]): tuple(r) for r in made.collect()} == whole
    assert {(r["id"], r["copy"]) for r in balance.oversample(uneven, "c", "id").collect()} == many
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.rindex("explode(sequence((_chunk")] if "explode(sequence((_chunk" in plan else plan.split("Generate")[0]
    assert "Join" not in above.split("Generate")[0]
    grown = spark.range(3).selectExpr("id", "7L as n")
    assert sorted(r["copy"] for r in balance._repeat(grown, F.col("n"), 1, 7).where("id = 1").collect()) == list(range(1, 8))


def test_equal_points_and_far_leaves_are_not_compared(spark, monkeypatch):
    """Copies of a point are one point with its first ids, and boxes that are too far are left out."""
    rows = spark.range(3000).select(F.col("id").alias("d_id"), F.array(F.lit(1.0)).alias("d_x"), F.struct(F.lit(0)).alias("d_row"))
    (point,) = neighbors._distinct_points(rows, 2, 3).collect()
    assert sorted(e["d_id"] for e in point["rows"]) == [0, 1, 2] and point["first"] == 0
    rng = np.random.default_rng(1)
    points = rng.normal(size=(8000, 2))
    pairs, plain = [0], neighbors._summed

    def counted(a, b):
        pairs[0] += max(a.shape[0] * b.shape[1] if a.ndim == 3 else len(a), 0)
        return plain(a, b)

    monkeypatch.setattr(neighbors, "_summed", counted)
    index = neighbors._Search(points, np.arange(8000), 2)
    leaves, starts = neighbors._leaves(points, neighbors.SLICE)
    for a, b in zip(starts[:-1], starts[1:]):
        mine = leaves[a:b]
        spot, at, _ = index.leaf(points[mine], np.full(len(mine), np.inf))
        assert (at[np.flatnonzero(np.diff(spot, prepend=-1))] == mine).all()
    assert pairs[0] < 8000 * 8000 / 5


def test_many_dimensions_are_exact(spark, monkeypatch):
    """Pairs chosen in single precision give the distances and ties of whole sums."""
    monkeypatch.setattr(neighbors, "WIDE_BYTES", 24 * 8 * 60)
    rng = np.random.default_rng(2)
    points = np.round(rng.normal(size=(150, 24)), 1) + 100.0
    points[40:80] = points[:40]
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, x array<double>")
    got = {}
    for r in sorted(neighbors.nearest(df, df, "id", "id", "x", 4, True).collect(), key=lambda r: (r["id"], r["place"])):
        got.setdefault(r["id"], []).append(r["neighbor_id"])
    assert got == brute(points, list(range(150)), points, range(150), 4, True)


def test_rows_that_lack_a_coordinate_are_left_out(spark):
    rows = [(0, [0.0, 0.0]), (1, [0.0, None]), (2, [1.0, 0.0]), (3, None), (4, [0.0, float("nan")]), (5, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    got = {(r["id"], r["neighbor_id"]) for r in neighbors.nearest(df, df, "id", "id", "x", 1, True).collect()}
    assert got == {(0, 2), (2, 0), (5, 0)}
