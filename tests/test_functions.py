"""Distributed building blocks against NumPy, with skew and small limits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepmill.functions import hashing, quantiles, ranges
from prepmill.functions.roles import columns_by_role, nan_to_null


def skewed(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    values = np.round(rng.lognormal(2, 1.5, n), 3)
    values[: n // 3] = 7.5
    return values


@pytest.mark.parametrize("limit", [10, 200, 10**6])
def test_quantiles_any_route(spark, limit):
    values = skewed()
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5)
    got = quantiles.quantile_values(df, ["v"], [0.0, 0.05, 0.25, 0.5, 0.75, 0.99, 1.0], direct_limit=limit)["v"]
    want = np.quantile(values, [0.0, 0.05, 0.25, 0.5, 0.75, 0.99, 1.0])
    assert np.allclose(got, want, atol=1e-9)


@pytest.mark.parametrize("limit", [10, 10**6])
def test_group_quantiles_any_route(spark, limit):
    values = skewed()
    group = ["a" if i % 10 else "b" for i in range(len(values))]
    rows = [(g, float(v)) for g, v in zip(group, values)] + [("c", 1.0), ("d", None), (None, 4.0), (None, 6.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = quantiles.quantiles(df, ["v"], [0.25, 0.5], by=["g"], direct_limit=limit).collect()
    got = {r["g"]: r["q"] for r in found if r["q"] is not None}
    for g in "ab":
        want = np.quantile(values[[i for i, x in enumerate(group) if x == g]], [0.25, 0.5])
        assert np.allclose(got[g], want)
    assert got["c"] == [1.0, 1.0] and got[None] == [4.5, 5.0]


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    assert quantiles.quantile_values(df, ["v"], [0.5])["v"] == [None]
    assert quantiles.quantile_values(df, ["v"], [0.5], direct_limit=0)["v"] == [None]


@pytest.mark.parametrize("buckets", [1, 3, 50])
@pytest.mark.parametrize("backward", [False, True])
def test_carry(spark, buckets, backward):
    rows = [(i, None if i % 7 else float(i)) for i in range(5, 200)]
    df = spark.createDataFrame(rows, "k long, v double").repartition(7)
    got = {r["k"]: r["v"] for r in ranges.carry_last(df, "v", "k", backward, buckets).collect()}
    for i, _ in rows:
        near = -(-i // 7) * 7 if backward else i // 7 * 7
        assert got[i] == (float(near) if 5 <= near < 200 else None)


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_by_group(spark, descending):
    rows = [(g, float(k), k % 3 + 1) for g in "xy" for k in range(100)]
    df = spark.createDataFrame(rows, "g string, k double, n long")
    out = ranges.running_sums(df, "k", {"upto": F.col("n")}, ["g"], descending, buckets=9).collect()
    for r in out:
        span = range(int(r["k"]), 100) if descending else range(int(r["k"]) + 1)
        assert r["upto"] == sum(k % 3 + 1 for k in span)


@pytest.mark.parametrize(
    "values", [["b", "a", "aa", "", "Ab", "é", "z", "a"], [f"Customer#{i:09d}" for i in range(300)], ["one"], []]
)
def test_dense_codes_text(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v string")
    got = {r["value"]: r["code"] for r in ranges.dense_codes(df, "v").collect()}
    assert got == {v: i for i, v in enumerate(sorted(set(values), key=str.encode))}


def test_dense_codes_numbers(spark):
    df = spark.createDataFrame([(v,) for v in [5, -3, 5, 10**17, 10**17 + 1]], "v long")
    got = {r["value"]: r["code"] for r in ranges.dense_codes(df, "v").collect()}
    assert got == {-3: 0, 5: 1, 10**17: 2, 10**17 + 1: 3}


def test_hash_pieces_do_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumn("c", F.when(F.col("id") % 3 == 0, "x").otherwise("y"))
    ranks = {"x": [100, 200], "y": [0, 333]}
    one = hashing.hash_piece(df.repartition(1), "id", "c", ranks, out="p")
    many = hashing.hash_piece(df.repartition(13), "id", "c", ranks, out="p")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    sizes = {(r["c"], r["p"]): r["count"] for r in one.groupBy("c", "p").count().collect()}
    assert sizes == {("x", 0): 100, ("x", 1): 100, ("x", 2): 134, ("y", 1): 333, ("y", 2): 333}


def test_hash_pieces_with_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(hashing, "ROWS_PER_BUCKET", 3)
    out = hashing.hash_piece(spark.range(500), "id", None, {"": [123]}, out="p")
    assert out.where("p = 0").count() == 123


def test_roles_and_nan(spark):
    df = spark.createDataFrame([(1, 2.0, float("nan"), "a", True, [1])], "i int, d double, n double, s string, b boolean, x array<int>")
    roles = columns_by_role(df)
    assert roles["numeric"] == ["i", "d", "n"] and roles["boolean"] == ["b"] and roles["nested"] == ["x"]
    assert nan_to_null(df).first()["n"] is None
