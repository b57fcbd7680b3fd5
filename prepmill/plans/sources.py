"""Reader and writer round trips over whole tables."""

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import check_features, read_csv, read_json, read_parquet, validate, write_csv, write_json, write_parquet
from ..sources.readers import SEPARATORS
from .base import query, rounded, table

LINE_TOTALS = """
select l_returnflag, l_linestatus, count(*) as n, count(l_shipdate) as n_dates,
       round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_price,
       min(l_shipdate) as first_ship, max(l_shipdate) as last_ship
from lineitem group by l_returnflag, l_linestatus
"""


def _line_totals(df):
    totals = df.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.count("l_shipdate").alias("n_dates"),
        F.sum("l_quantity").alias("sum_qty"), F.sum("l_extendedprice").alias("sum_price"),
        F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"),
    )
    return rounded(totals, 2)


@query("io1_read_csv", LINE_TOTALS)
def io1(spark, sf):
    line = table(spark, sf, "lineitem")
    path = write_csv(line, scratch_path(spark, "csv"))
    return _line_totals(read_csv(spark, path, schema=line.schema))


@query("io1_late_latin1", """
select c_custkey, c_name || case when c_custkey >= (select max(c_custkey) from customer) then ' né' else '' end as c_name
from customer""")
def io1_latin(spark, sf):
    """Latin-1 files whose only byte beyond ASCII is in the last row of the last one."""
    names = table(spark, sf, "customer").select("c_custkey", "c_name")
    last = names.agg(F.max("c_custkey")).first()[0]
    tail = F.when(F.col("c_custkey") >= F.lit(last), F.lit(" n\u00e9")).otherwise("")
    rows = names.select("c_custkey", F.concat("c_name", tail).alias("c_name"))
    path = scratch_path(spark, "csv")
    ranges = rows.repartitionByRange("c_custkey").sortWithinPartitions("c_custkey")
    ranges.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return read_csv(spark, path, schema=rows.schema)


@query("io1_semicolon_inferred", """
select cast(s_suppkey as int) as s_suppkey, s_name, cast(s_nationkey as int) as s_nationkey, s_acctbal from supplier""")
def io1_semicolon(spark, sf):
    """Separator and types are found in the file."""
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    path = scratch_path(spark, "csv")
    rows.write.option("header", True).option("sep", ";").csv(path)
    return read_csv(spark, path)


@query("io1_gzip", """
select cast(s_suppkey as int) as s_suppkey, s_name || '; ' || s_suppkey as s_name, cast(s_nationkey as int) as s_nationkey from supplier""")
def io1_gzip(spark, sf):
    """Compressed files whose texts hold other separators."""
    rows = table(spark, sf, "supplier").select("s_suppkey", F.concat("s_name", F.lit("; "), "s_suppkey").alias("s_name"), "s_nationkey")
    path = scratch_path(spark, "csv")
    rows.write.option("header", True).option("compression", "gzip").csv(path)
    return read_csv(spark, path)


@query("io1_quoted_header", """
select cast(p_partkey as int) as "part;key;number", p_name || ';' || p_brand as "name;brand" from part""")
def io1_quoted(spark, sf):
    """Names and values with more semicolons than the file has separators."""
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("part;key;number"), F.concat_ws(";", "p_name", "p_brand").alias("name;brand"))
    path = scratch_path(spark, "csv")
    rows.write.option("header", True).option("quoteAll", True).csv(path)
    return read_csv(spark, path)


@query("io1_mixed_separators", """
select c_custkey, c_name, c_acctbal, c_nationkey % 4 as sep from customer""")
def io1_mixed(spark, sf):
    """One table in folders whose files differ in their separator."""
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", (F.col("c_nationkey") % 4).alias("sep"))
    path = scratch_path(spark, "csv")
    for k, mark in enumerate(SEPARATORS):
        rows.where(F.col("sep") == k).drop("sep").write.option("header", True).option("sep", mark).csv(f"{path}/sep={k}")
    return read_csv(spark, path, schema="c_custkey bigint, c_name string, c_acctbal double, sep int")


@query("io2_read_json", LINE_TOTALS)
def io2(spark, sf):
    line = table(spark, sf, "lineitem")
    path = write_json(line, scratch_path(spark, "json"))
    return _line_totals(read_json(spark, path, schema=line.schema, multi_line=False))


@query("io3_read_parquet", LINE_TOTALS)
def io3(spark, sf):
    return _line_totals(read_parquet(spark, f"{sf}/lineitem.parquet"))


@query(
    "io4_validate",
    "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer",
)
def io4(spark, sf):
    return validate(table(spark, sf, "customer"))


@query(
    "io5_scoring_input",
    "select p_size, p_retailprice from part",
)
def io5(spark, sf):
    part = table(spark, sf, "part")
    path = write_csv(part, scratch_path(spark, "score-in"))
    loaded = read_csv(spark, path, schema=part.schema)
    features = ["p_size", "p_retailprice"]
    check_features(loaded, features)
    return loaded.select(*features)


DOCUMENTS = "select doc_id, text, lang, source, n_chars from documents"


@query("io6_write_csv", DOCUMENTS)
def io6(spark, sf):
    docs = table(spark, sf, "documents")
    path = write_csv(docs, scratch_path(spark, "csv"))
    return read_csv(spark, path, schema=docs.schema)


@query("io7_write_json", DOCUMENTS)
def io7(spark, sf):
    docs = table(spark, sf, "documents")
    path = write_json(docs, scratch_path(spark, "json"))
    return read_json(spark, path, schema=docs.schema)


@query("io8_write_parquet", DOCUMENTS)
def io8(spark, sf):
    docs = table(spark, sf, "documents")
    return read_parquet(spark, write_parquet(docs, scratch_path(spark, "parquet")))
