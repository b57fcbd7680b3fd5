"""Readers, writers, streams, and the shape of physical plans."""

import gzip

import pytest
from pyspark.sql import functions as F

import prepmill.sources as sources
from prepmill.operators import duplicates, missing, models, package, profile, training, view
from prepmill.plans import base
from prepmill.session import scratch_path
from prepmill.sources import readers
from prepmill.streaming import incoming_files, write_stream


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def put(tmp_path, name, data: bytes):
    path = tmp_path / name
    path.write_bytes(data)
    return str(path)


def test_csv_separator_and_encoding(spark, tmp_path):
    semi = put(tmp_path, "a.csv", b"n;t\n1;x\n2;y\n")
    assert [tuple(r) for r in sources.read_csv(spark, semi).collect()] == [(1, "x"), (2, "y")]
    latin = put(tmp_path, "b.csv", "n,t\n1,é\n2,ü\n".encode("latin-1"))
    assert [r["t"] for r in sources.read_csv(spark, latin).collect()] == ["é", "ü"]
    utf = put(tmp_path, "c.csv", "n,t\n1,é\n".encode())
    assert sources.read_csv(spark, utf, row_id="_row_id").first()["t"] == "é"


def test_csv_quotes_and_line_breaks(spark):
    rows = [(1, 'say "hi", twice\nand go'), (2, "plain"), (3, None)]
    path = sources.write_csv(spark.createDataFrame(rows, "k int, t string"), scratch_path(spark, "csv"))
    back = sources.read_csv(spark, path, schema="k int, t string")
    assert sorted(map(tuple, back.collect())) == rows


def test_csv_is_judged_by_all_its_bytes(spark, tmp_path):
    """A late Latin-1 byte, and files of different kinds in one folder."""
    rows = "".join(f"{k},plain {k}\n" for k in range(150_000))
    late = put(tmp_path, "late.csv", ("k,t\n" + rows + "-1,café\n").encode("latin-1"))
    assert len(rows) > 1 << 20
    back = sources.read_csv(spark, late)
    assert back.where("k = -1").first()["t"] == "café" and back.count() == 150_001
    assert back.where(F.col("t").contains("\ufffd")).isEmpty()
    folder = tmp_path / "mixed"
    folder.mkdir()
    put(folder, "a.csv", b"k,t\n1,one\n")
    put(folder, "b.csv", "k,t\n2.5,é\n".encode())
    put(folder, "c.csv", "k,t\n3,ü\n".encode("latin-1"))
    put(folder, "d.csv", b'k,t\n4,"two\nlines"\n')
    back = sources.read_csv(spark, str(folder))
    assert sorted(map(tuple, back.collect())) == [(1.0, "one"), (2.5, "é"), (3.0, "ü"), (4.0, "two\nlines")]


def test_csv_kinds_in_partition_folders(spark, tmp_path):
    """Files of different kinds keep the partition columns that one kind has."""
    files = {"k=01/a.csv": b"t\none\n", "k=01/b.csv": "t\né\n".encode("latin-1"), "k=b c/c.csv": b't\n"two\nlines"\n'}
    for name, data in files.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        put(tmp_path / "in", name, data)
    want = [("one", "01"), ("two\nlines", "b c"), ("é", "01")]
    for schema in (None, "t string", "t string, k string"):
        back = sources.read_csv(spark, str(tmp_path / "in"), schema=schema)
        assert sorted(map(tuple, back.collect())) == want and back.columns == ["t", "k"]
    # Folders named by a pattern have no partition columns, as for Spark.
    assert sources.read_csv(spark, str(tmp_path / "in" / "k=*")).columns == ["t"]


def test_csv_lines_are_judged_without_sorting_them(spark, tmp_path, monkeypatch):
    """No line's text is kept in the aggregate over all lines, which Spark would do by sorting (and spilling) them."""
    plans = []
    kind = type(spark.range(1))
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: plans.append(
        df._jdf.queryExecution().executedPlan().toString()) or collect(df))
    path = put(tmp_path, "many.csv", b"k;t\n" * 50 + b'1;"a, b"\n2;c\n' * 500)
    kinds = readers._csv_kinds(spark, path, None)
    # The aggregate next to the scan is the last one in the printed tree.
    lowest = [[line for line in p.splitlines() if "Aggregate(" in line][-1] for p in plans if "Scan text" in p]
    assert lowest and all("HashAggregate(" in line for line in lowest)
    assert [(k.sep, k.names, k.breaks, k.utf8) for k in kinds.values()] == [(";", ("k", "t"), False, True)]


def test_csv_separator_by_all_lines(spark, tmp_path):
    """Compressed files, separators inside quotes, texts full of other separators, and folders of both."""
    read = lambda path, **o: [tuple(r) for r in sources.read_csv(spark, path, **o).collect()]
    zipped = put(tmp_path, "a.csv.gz", gzip.compress(b"id,name,v\n" + b"".join(b"%d,x;y;%d,3\n" % (k, k) for k in range(500))))
    assert sources.read_csv(spark, zipped).columns == ["id", "name", "v"] and len(read(zipped)) == 500
    quoted = put(tmp_path, "b.csv", b'"x;y;z",b\n"1;2;3",4\n"""5;""",6\n')
    assert sources.read_csv(spark, quoted).columns == ["x;y;z", "b"] and read(quoted) == [("1;2;3", 4), ('"5;"', 6)]
    decimal = put(tmp_path, "c.csv", b"a;b;c\n1,5;2,5;3,5\n4,5;5,5;6,5\n")
    assert sources.read_csv(spark, decimal).columns == ["a", "b", "c"]
    prose = put(tmp_path, "d.csv", b"name|note\n" + b"".join(b"n%d|one, two; three, %d\n" % (k, k) for k in range(50)))
    assert sources.read_csv(spark, prose).columns == ["name", "note"]
    single = put(tmp_path, "e.csv", b"\n\nname\nSmith; John\nDoe; Jane\n")
    assert sources.read_csv(spark, single).columns == ["name"]
    breaks = put(tmp_path, "f.csv", b'a\tb\n1\t"two, three,\nfour, five"\n2\tsix\n')
    assert read(breaks) == [(1, "two, three,\nfour, five"), (2, "six")]
    folder = tmp_path / "mixed"
    folder.mkdir()
    put(folder, "a.csv", b"a,b\n1,2\n")
    put(folder, "b.csv", b"a;b\n5;6\n")
    assert sorted(read(str(folder))) == [(1, 2), (5, 6)]
    assert sorted(read(str(folder), schema="a int, b int")) == [(1, 2), (5, 6)]
    put(folder, "c.csv", b"b,a\n7,8\n")
    with pytest.raises(ValueError, match="columns differ"):
        sources.read_csv(spark, str(folder))


def test_late_latin1_is_written_by_several_tasks(spark, sf, monkeypatch):
    from prepmill.plans import sources as plans

    seen = []
    monkeypatch.setattr(plans, "read_csv", lambda s, path, **o: seen.append(path) or sources.read_csv(s, path, **o))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        back = plans.io1_latin(spark, sf)
    finally:
        spark.conf.set(key, was)
    files = spark.read.format("binaryFile").load(seen[0]).where("length > 0").select("path", "content").collect()
    odd = [f["path"] for f in files if not f["content"].isascii()]
    assert len(files) > 1 and odd == [max(f["path"] for f in files)]
    assert back.where(F.col("c_name").endswith(" né")).count() == 1 and back.count() == base.table(spark, sf, "customer").count()


def test_csv_nan_is_missing(spark, tmp_path):
    path = put(tmp_path, "n.csv", b"k,v\n1,NaN\n2,3.5\n")
    df = sources.read_csv(spark, path, schema="k int, v double")
    assert df.where("v is null").count() == 1


def test_json_array_and_lines(spark, tmp_path):
    array = put(tmp_path, "a.json", b'[{"a": 1, "b": null},\n {"a": 2, "b": "x"}]')
    assert sources.read_table(spark, array).count() == 2
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    path = sources.write_json(df, scratch_path(spark, "json"))
    assert spark.read.text(path).where(F.col("value").contains('"b":null')).count() == 1
    assert sources.read_json(spark, path).count() == 2


def test_json_lines_are_judged_by_all_their_bytes(spark, tmp_path):
    """A first record above 1 MiB, a blank line, a byte order mark and a broken line lose no other row."""
    long = '{"a": 0, "b": "' + "x" * (1 << 21) + '"}\n'
    lines = "".join(f'{{"a": {k}, "b": "y"}}\n' for k in range(1, 4))
    heads = {"long": long, "blank": '\n{"a": 0}\n', "bom": '\ufeff{"a": 0}\n', "broken": '{"a": 0, "b"\n'}
    for name, head in heads.items():
        path = put(tmp_path, f"{name}.json", (head + lines).encode())
        for schema in (None, "a bigint, b string"):
            back = sources.read_json(spark, path, schema=schema)
            assert back.where("a > 0").count() == 3 and back.count() == 4, name


def test_json_kinds_in_one_folder(spark, tmp_path):
    """Lines, a pretty-printed array and one record over lines, in partition folders."""
    files = {
        "k=1/a.json": '{"a": 1, "b": null, "c": null}\n{"a": 2, "b": null, "c": null}\n',
        "k=1/b.json": '[\n  {"a": 2.5, "b": {"x": 1}},\n  {"a": 4, "b": null}\n]\n',
        "k=b c/c.json": '{\n  "a": 5,\n  "d": [\n{"y": 1}\n]\n}\n',
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        put(tmp_path, name, text.encode())
    back = sources.read_json(spark, str(tmp_path))
    assert dict(back.dtypes) == {"a": "double", "b": "struct<x:bigint>", "c": "string", "d": "array<struct<y:bigint>>", "k": "string"}
    assert sorted(tuple(r) for r in back.select("a", "k", "b.x").fillna(-1).collect()) == [
        (1.0, "1", -1), (2.0, "1", -1), (2.5, "1", 1), (4.0, "1", -1), (5.0, "b c", -1)]
    given = sources.read_json(spark, str(tmp_path), schema="a double")
    assert sorted(map(tuple, given.collect())) == [(1.0, "1"), (2.0, "1"), (2.5, "1"), (4.0, "1"), (5.0, "b c")]


def test_refused_inputs(spark, tmp_path):
    with pytest.raises(ValueError, match="unsupported"):
        sources.read_table(spark, "/nowhere/table.xyz")
    with pytest.raises(ValueError, match="no rows"):
        sources.validate(spark.createDataFrame([], "a int"))
    with pytest.raises(ValueError, match="missing features: z"):
        sources.check_features(spark.createDataFrame([(1,)], "a int"), ["a", "z"])
    with pytest.raises(ValueError):
        sources.write_table(spark.range(1), str(tmp_path / "x"), "xls")


def test_fills_and_duplicates_use_no_single_task(spark, sf):
    """No window over raw rows may gather them in one partition."""
    events = base.view(spark, sf, "events_gap")
    for df in (missing.forward_fill(events, "v", "event_id"), missing.backward_fill(events, "v", "event_id")):
        # The pass over bucket summaries starts from a one-partition range of bucket numbers.
        plan = plan_of(df)
        assert "SinglePartition" not in plan and "Range (" in plan
    part = base.view(spark, sf, "part_dup")
    for df in (duplicates.mark(part, ["branch"]), duplicates.keep_first(part, ["branch"]), duplicates.remove_all(part, ["branch"])):
        assert "SinglePartition" not in plan_of(df)


def test_filters_and_columns_reach_the_scan(spark, sf):
    line = base.table(spark, sf, "lineitem")
    plan = plan_of(view.matching_rows(line, "l_quantity", ">", 30).select("l_orderkey"))
    assert "GreaterThan(l_quantity,30.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_no_cross_joins_in_reports(spark, sf):
    part = base.view(spark, sf, "part_dup")
    for df in (profile.quality_issues(part), profile.change_summary(part, part.limit(5)), profile.column_info(part)):
        plan = plan_of(df)
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_rows_do_not_depend_on_partitions(spark, sf):
    events = base.view(spark, sf, "events_gap")
    a = missing.forward_fill(events.repartition(3), "v", "event_id").agg(F.sum("v"), F.count("v")).first()
    b = missing.forward_fill(events.repartition(11), "v", "event_id").agg(F.sum("v"), F.count("v")).first()
    assert a[1] == b[1] and abs(a[0] - b[0]) < 1e-6


def test_scoring_a_stream(spark, sf, tmp_path):
    part = base.table(spark, sf, "part").select("p_partkey", "p_size", "p_type", "p_retailprice")
    prepared = training.prepare(part, ["p_size", "p_type"], "p_retailprice", "p_partkey")
    model = models.fit_model("linear", "regression", prepared.slim(part))
    saved = package.load_package(spark, package.save_package(
        spark, scratch_path(spark, "m"), model, prepared.preprocessor, prepared.features, "p_retailprice"))
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows = part.drop("p_retailprice")
    rows.where("p_partkey < 100").write.parquet(folder)
    for _ in range(2):
        stream = incoming_files(spark, folder, rows.schema)
        work = lambda df: saved.transform(df).select("p_partkey", "prediction")
        write_stream(stream, out, work, mark).awaitTermination()
        done = spark.read.parquet(out)
        rows.where("p_partkey >= 100").write.mode("append").parquet(folder) if done.count() == 100 else None
    want = saved.transform(rows).select("p_partkey", F.col("prediction").alias("w"))
    both = spark.read.parquet(out).join(want, "p_partkey")
    assert both.count() == part.count() and both.where("abs(prediction - w) > 1e-9").count() == 0
