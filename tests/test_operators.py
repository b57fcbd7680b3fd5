"""Edge cases of the table operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prepmill.operators import charts, cleaning, columns, duplicates, missing, outliers, profile, reshape, view


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def gaps(spark):
    return frame(spark, [(1, None, "a"), (2, 5.0, None), (3, None, "a"), (4, 7.0, "b")], "k long, v double, s string")


def test_overview_of_empty_table(spark):
    row = profile.overview(frame(spark, [], "a int, b string")).first()
    assert (row["n_rows"], row["n_columns"], row["missing_pct"]) == (0, 2, 0.0)


def test_column_info_edges(spark):
    df = frame(spark, [(None, 0.0, "x"), (None, -0.0, "x"), (None, 2.0, "")], "n int, z double, s string")
    info = {r["column"]: r for r in profile.column_info(df).collect()}
    assert info["n"]["n_unique"] == 0 and info["n"]["null_pct"] == 100.0
    assert info["z"]["n_unique"] == 2
    assert info["s"]["n_unique"] == 2
    approx = {r["column"]: r["n_unique"] for r in profile.column_stats(df, approx=True).collect()}
    assert approx == {"n": 0, "z": 2, "s": 2}


def test_duplicates_with_nulls(spark):
    df = frame(spark, [(1, None), (1, None), (1, None), (2, "a")], "a int, b string")
    assert profile.duplicate_count(df).first()[0] == 2
    assert duplicates.duplicate_rows(df).count() == 3
    assert duplicates.remove_all(df).collect() == [(2, "a")]
    assert duplicates.duplicate_groups(df).first()["copies"] == 3
    assert sorted(r["is_duplicate"] for r in duplicates.mark(df).collect()) == [False, True, True, True]


def test_all_rows_equal(spark):
    df = frame(spark, [(1, "a")] * 5, "a int, b string")
    assert duplicates.remove_all(df).count() == 0
    assert duplicates.keep_first(df).count() == 1


def test_keep_first_and_last_use_the_order_key(spark):
    df = frame(spark, [("a", 3, 1), ("a", 1, 2), ("a", 2, 0), ("b", 9, 9)], "v string, k int, l int")
    assert {tuple(r) for r in duplicates.keep_first(df, ["k", "l"]).collect()} == {("a", 1, 2), ("b", 9, 9)}
    assert {tuple(r) for r in duplicates.keep_last(df, ["k", "l"]).collect()} == {("a", 3, 1), ("b", 9, 9)}


def test_hot_groups_take_the_lookup_route(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "HOT_ROWS", 20)
    rows = [("hot" if i % 3 else f"v{i % 50}", i) for i in range(600)] + [(None, 1000 + i) for i in range(30)]
    df = frame(spark, rows, "v string, k int")
    got = {r["k"]: r["_copies"] for r in duplicates.with_copies(df, ["k"]).collect()}
    sizes = {}
    for v, _ in rows:
        sizes[v] = sizes.get(v, 0) + 1
    assert got == {k: sizes[v] for v, k in rows}


def test_copies_are_unrolled_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "CHUNK", 7)
    df = frame(spark, [("a",)] * 50 + [("b",)], "v string")
    assert duplicates.with_copies(df).groupBy("v").count().orderBy("v").collect() == [("a", 50), ("b", 1)]


def test_missing_repairs(gaps):
    assert missing.drop_missing(gaps, "v").count() == 2
    assert [r["v"] for r in missing.impute_mean(gaps, "v").orderBy("k").collect()] == [6.0, 5.0, 6.0, 7.0]
    assert [r["s"] for r in missing.impute_mode(gaps, "s").orderBy("k").collect()] == ["a", "a", "a", "b"]
    assert [r["v"] for r in missing.forward_fill(gaps, "v", "k").orderBy("k").collect()] == [None, 5.0, 5.0, 7.0]
    assert [r["v"] for r in missing.backward_fill(gaps, "v", "k").orderBy("k").collect()] == [5.0, 5.0, 7.0, 7.0]


def test_mode_ties_and_nothing(spark):
    assert missing.most_frequent(frame(spark, [("b",), ("a",), (None,)], "s string"), "s") == "a"
    empty = frame(spark, [(None,), (None,)], "s string")
    assert {r["s"] for r in missing.impute_mode(empty, "s").collect()} == {"Unknown"}


def test_all_null_numbers_stay(spark):
    df = frame(spark, [(1, None), (2, None)], "k int, v double")
    assert {r["v"] for r in missing.impute_median(df, "v").collect()} == {None}
    assert outliers.cap_outliers(df, "v").count() == 2
    assert outliers.remove_outliers(df, "v").count() == 0
    assert profile.describe(df, "v").first()["count"] == 0


def test_constant_and_correlated_columns(spark):
    rows = [(i, 1, None, 0.1, i * 2.0, (-1.0) ** i) for i in range(30)]
    df = frame(spark, rows, "a int, c int, n string, tenth double, twice double, flip double")
    assert cleaning.constant_columns(df) == ["c", "n", "tenth"]
    assert cleaning.correlated_columns(df) == ["twice"]
    assert cleaning.drop_correlated(df.select("a")).columns == ["a"]


def test_correlation_skips_gaps_pairwise(spark):
    rows = [(1.0, 2.0, None), (2.0, 4.5, 1.0), (3.0, None, 5.0), (4.0, 8.0, 2.0), (6.0, 1.0, 3.0)]
    df = frame(spark, rows, "x double, y double, z double")
    pdf = df.toPandas().corr()
    for r in charts.correlation_pairs(df).collect():
        assert math.isclose(r["r"], pdf.loc[r["col_a"], r["col_b"]], abs_tol=1e-12)


def test_casts(spark):
    df = frame(spark, [("7",), ("7.5",), ("abc",), ("",), (None,), ("9007199254740993",), ("1e3",)], "t string")
    got = [r["t"] for r in columns.to_integer(df, "t").collect()]
    assert got == [7, None, None, None, None, 9007199254740993, 1000]
    assert [r["t"] for r in columns.to_integer(df, "t", "truncate").collect()][1] == 7
    assert [r["t"] for r in columns.to_float(df, "t").collect()][:4] == [7.0, 7.5, None, None]
    assert [r["t"] for r in columns.to_boolean(df, "t").collect()][3:5] == [False, None]
    assert [r["t"] for r in columns.to_boolean(df, "t", "truthy").collect()][4] is True
    with pytest.raises(Exception, match="fraction"):
        columns.to_integer(df, "t", "raise").collect()


def test_datetimes(spark):
    df = frame(spark, [(1_700_000_000_123_456_000, "2024-02-29 10:00:00"), (None, "2024-02-30")], "n long, t string")
    got = columns.to_datetime(columns.to_datetime(df, "n"), "t").collect()
    assert str(got[0]["n"]) == "2023-11-14 22:13:20.123456" and got[1]["n"] is None
    assert str(got[0]["t"]) == "2024-02-29 10:00:00" and got[1]["t"] is None


def test_column_names_are_checked(spark):
    df = frame(spark, [(1, 2)], "a int, b int")
    with pytest.raises(ValueError):
        columns.rename(df, "a", "B")
    with pytest.raises(ValueError):
        columns.rename(df, "zz", "c")
    with pytest.raises(ValueError):
        columns.drop(df, ["zz"])
    assert columns.rename(df, "a", "A").columns == ["A", "b"]


def test_split_and_merge(spark):
    df = frame(spark, [("a.b.c", None), (None, "x")], "t string, u string")
    row = columns.split(df, "t", ".", ["p", "q"]).first()
    assert (row["p"], row["q"]) == ("a", "b.c")
    assert [r["m"] for r in columns.merge(df, ["t", "u"], "m", "-").collect()] == ["a.b.c", "x"]


def test_pivot_edges(spark):
    df = frame(spark, [("a", "x", 1.0), ("a", None, 5.0), (None, "x", 9.0), ("b", "y", 3.0), ("b", "y", 5.0)], "i string, c string, v double")
    got = {r["i"]: (r["x"], r["y"]) for r in reshape.pivot(df, ["i"], "c", "v", "std").collect()}
    assert got == {"a": (0.0, 0.0), "b": (0.0, math.sqrt(2))}
    with pytest.raises(ValueError):
        reshape.distinct_values(df, "c", 1)


def test_unpivot_mixed_types_keeps_gaps(spark):
    df = frame(spark, [(1, "a", None), (2, None, 2.5)], "k int, s string, d double")
    got = sorted(reshape.unpivot(df, ["k"]).collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(1, "s", "a"), (1, "d", None), (2, "s", None), (2, "d", "2.5")], key=str)
    assert reshape.unpivot(df, [], ["d"]).columns == ["variable", "value"]


def test_comparisons_with_gaps(gaps):
    assert view.matching_rows(gaps, "v", "!=", 5).count() == 3
    assert view.matching_rows(gaps, "v", ">", "5").count() == 1
    assert cleaning.remove_where(gaps, "v", ">", 5).count() == 3
    assert cleaning.remove_where(gaps, "s", "!=", "a").count() == 2
    with pytest.raises(TypeError):
        view.matching_rows(gaps, "v", "==", "text")
    changed = cleaning.replace_where(gaps, "s", "==", "z", "a").orderBy("k").collect()
    assert [r["s"] for r in changed] == ["z", None, "z", "b"]


def test_sorting_puts_gaps_last(gaps):
    for up in (True, False):
        assert [r["v"] for r in view.sort(gaps, "v", ["k"], up).collect()][2:] == [None, None]
    assert [r["k"] for r in view.tail(gaps, 2, ["k"]).collect()] == [3, 4]


def test_sample_is_repeatable(spark):
    df = spark.range(500)
    one = {r[0] for r in view.sample(df.repartition(3), 50, "id").collect()}
    assert one == {r[0] for r in view.sample(df.repartition(11), 50, "id").collect()} and len(one) == 50


def test_large_samples_take_the_same_rows(spark, monkeypatch):
    df = spark.range(500)
    one = {r[0] for r in view.sample(df, 50, "id").collect()}
    monkeypatch.setattr(view, "TOP_K_ROWS", 10)
    assert {r[0] for r in view.sample(df, 50, "id").collect()} == one
    assert view.sample(df, 900, "id").count() == 500


def test_histogram_of_a_constant(spark):
    got = charts.histogram(frame(spark, [(2.0,)] * 4, "v double"), "v", 10).orderBy("bin").collect()
    assert len(got) == 10 and sum(r["n"] for r in got) == 4
    assert got[0]["low"] == 1.5 and got[-1]["high"] == 2.5 and got[5]["n"] == 4


def test_density_adds_up_to_one(spark):
    df = frame(spark, [(float(i % 17),) for i in range(300)], "v double")
    for fine in (None, 4096):
        rows = charts.density(df, "v", fine_bins=fine).orderBy("point").collect()
        step = rows[1]["x"] - rows[0]["x"]
        assert abs(sum(r["density"] for r in rows) * step - 1) < 0.01


def test_winsorize_takes_order_statistics(spark):
    df = frame(spark, [(float(i),) for i in range(40)] + [(None,)], "v double")
    got = [r["v"] for r in outliers.winsorize(df, "v").collect() if r["v"] is not None]
    assert min(got) == 2.0 and max(got) == 37.0 and len(got) == 40


def test_conditional_needs_a_replacement(gaps):
    with pytest.raises(ValueError):
        cleaning.replace_where(gaps, "s", "==", "", "a")


def test_skew_and_kurtosis_of_few_or_equal_values(spark):
    df = frame(spark, [(1.0, 2.0), (1.0, 3.0)], "c double, v double")
    assert [r["skewness"] for r in profile.skewness(df, ["c", "v"]).collect()] == [None, None]
    same = frame(spark, [(1.0,)] * 6, "c double")
    assert profile.kurtosis(same, ["c"]).first()["kurtosis"] is None


def test_frequency_table(spark):
    df = frame(spark, [("a",), ("a",), (None,)], "s string")
    got = {r["value"]: r["n"] for r in profile.value_frequencies(df).collect()}
    assert got == {"a": 2, None: 1}
    assert df.select(F.count("s")).first()[0] == 2


def test_density_of_many_values_stays_near_the_exact_curve(spark):
    """Values dealt to nodes move the curve by less than the stated bound; rows never meet the grid."""
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(size=1500), rng.exponential(40, size=500)])
    rows = [(float(v), "ab"[i % 2]) for i, v in enumerate(values)] + [(None, "a"), (3.0, None), (1.0, "lone")]
    df = frame(spark, rows, "v double, g string").repartition(4)
    exact = {(r["g"], r["point"]): r["density"] for r in charts.density_by(df, "v", "g").collect()}
    near = {(r["g"], r["point"]): r["density"] for r in charts.density_by(df, "v", "g", exact_values=10).collect()}
    assert exact.keys() == near.keys() and len(exact) == 400
    for g in "ab":
        mine = np.array([v for v, x in rows if x == g and v is not None])
        h = mine.std(ddof=1) * len(mine) ** -0.2
        x = np.linspace(mine.min() - 3 * h, mine.max() + 3 * h, 200)
        plain = np.exp(-0.5 * ((x[:, None] - mine[None, :]) / h) ** 2).sum(axis=1) / (len(mine) * h * math.sqrt(2 * math.pi))
        assert np.abs(plain - [exact[g, p] for p in range(200)]).max() < 1e-12
        bound = charts.DENSITY_STEP ** 2 / 8 / (h * math.sqrt(2 * math.pi))
        assert np.abs(plain - [near[g, p] for p in range(200)]).max() <= bound * 1.001


def test_correlations_of_many_columns_take_one_pass(spark, monkeypatch):
    """Sixty columns with gaps: a scan for means and one for all pairs; blocks and empty tables give the same pairs."""
    rng = np.random.default_rng(3)
    data = rng.normal(size=(80, 60)) @ rng.normal(size=(60, 60)) + 1e6
    data[:, 7] = 5.0
    gone = rng.random(data.shape) < 0.2
    rows = [tuple(None if g else float(v) for v, g in zip(r, m)) for r, m in zip(data, gone)]
    df = frame(spark, rows, ", ".join(f"c{i} double" for i in range(60))).repartition(3).persist()
    want = pd.DataFrame(np.where(gone, np.nan, data), columns=df.columns).corr()
    pairs = charts.correlation_pairs(df)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InMemoryTableScan") == 1 and plan.count("MapInArrow") == 1
    got = {(r["col_a"], r["col_b"]): r["r"] for r in pairs.collect()}
    assert len(got) == 60 * 59 // 2
    for (a, b), r in got.items():
        assert r is None if "c7" in (a, b) else r == pytest.approx(want[a][b], abs=1e-9)
    monkeypatch.setattr(charts, "GRAM_COLUMNS", 25)
    again = {(r["col_a"], r["col_b"]): r["r"] for r in charts.correlation_pairs(df).collect()}
    assert again == {k: v if v is None else pytest.approx(v, abs=1e-9) for k, v in got.items()}
    empty = charts.correlation_pairs(df.limit(0).select("c1", "c2", "c3")).collect()
    assert [tuple(r) for r in empty] == [("c1", "c2", None), ("c1", "c3", None), ("c2", "c3", None)]


def test_comparisons_reach_the_scan_with_the_default_reader(spark, sf, tmp_path):
    from prepmill.operators import cleaning
    from prepmill.sources import read_parquet

    rows = [(1, 5.0), (2, float("nan")), (3, None), (4, 50.0), (5, 30.0)]
    path = str(tmp_path / "nan.parquet")
    frame(spark, rows, "k int, v double").write.parquet(path)
    df = read_parquet(spark, path)
    pushed = lambda d: d._jdf.queryExecution().executedPlan().toString().split("PushedFilters: [")[1].split("]")[0]
    for op, want in ((">=", [4, 5]), (">", [4]), ("<", [1]), ("<=", [1, 5]), ("==", [5]), ("!=", [1, 2, 3, 4])):
        kept = read_parquet(spark, path, where=("v", op, 30))
        assert sorted(r["k"] for r in kept.collect()) == want == sorted(r["k"] for r in view.matching_rows(df, "v", op, 30).collect())
        left = cleaning.remove_where(df, "v", op, 30)
        assert sorted(r["k"] for r in left.collect()) == sorted({1, 2, 3, 4, 5} - set(want))
        assert op == "!=" or "v" in pushed(kept)
