"""Registry of queries and checks, table loading, and the derived test views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import read_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Views defined by the same text in Spark SQL and DuckDB.
VIEWS = {
    "events_null": (
        "select event_id, ts, user_id, case when event_id % 5 <> 0 then event_type end as event_type, "
        "case when event_id % 7 <> 0 then value end as value from events"
    ),
    "events_gap": "select event_id, case when event_id % 3 = 0 then value end as v from events",
    "part_dup": (
        "select *, 0 as branch from part union all "
        "select *, 1 as branch from part where p_partkey % 10 = 0"
    ),
    "line_clean": "select *, 1 as konst, l_quantity * 2 + 1 as q2 from lineitem",
    "imb": (
        "select event_id, user_id, cast(length(props) as int) as plen, value, "
        "case when value > 100 then 1 else 0 end as label from events"
    ),
    "regpred": (
        "select p_partkey, p_retailprice as label, cast(900 + p_size as double) as prediction from part"
    ),
    "clspred": (
        "select l_returnflag as label, "
        "case l_linenumber % 3 when 0 then 'A' when 1 then 'N' else 'R' end as prediction from lineitem"
    ),
    "preds_long": (
        "select 'by_three' as model, l_orderkey % 5 as fold, l_returnflag as label, "
        "case l_linenumber % 3 when 0 then 'A' when 1 then 'N' else 'R' end as prediction from lineitem "
        "union all "
        "select 'by_two' as model, l_orderkey % 5 as fold, l_returnflag as label, "
        "case l_linenumber % 2 when 0 then 'A' else 'N' end as prediction from lineitem"
    ),
    "binscore": (
        "select o_orderkey, round((o_totalprice - lo) / (hi - lo), 2) as score, "
        "case when o_orderstatus = 'F' then 1 else 0 end as label, "
        "case when round((o_totalprice - lo) / (hi - lo), 2) >= 0.5 then 1 else 0 end as prediction "
        "from orders cross join (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders) m"
    ),
    "text_num": (
        "select event_id, case when event_id % 4 = 0 then 'n/a' else cast(value as {text}) end as t, "
        "event_type, value from events"
    ),
}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query function and, when SQL can state it, its independent check."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, views)
        return fn

    return register


def with_views(sql: str, views: tuple[str, ...]) -> str:
    """Prefix the named views as common table expressions."""
    body = sql.strip()
    if not views:
        return body
    parts = ", ".join(f"{v} as ({VIEWS[v].format(text='varchar')})" for v in views)
    if body.lower().startswith("with "):
        return f"with {parts}, {body[5:]}"
    return f"with {parts} {body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One base table.  The test tables hold no NaN, so float filters may reach the scan."""
    return read_parquet(spark, f"{sf_dir}/{name}.parquet", nan_as_null=False)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived view."""
    if name == "binscore":
        return _binscore(table(spark, sf_dir, "orders"))
    text = VIEWS[name].format(text="string")
    bases = [t for t in ("events", "part", "lineitem") if f" from {t}" in text]
    return spark.sql(
        text.replace(f" from {bases[0]}", " from {src}"), src=table(spark, sf_dir, bases[0])
    )


def _binscore(orders: DataFrame) -> DataFrame:
    ends = orders.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi")).first()
    score = F.round((F.col("o_totalprice") - ends["lo"]) / (F.lit(ends["hi"]) - ends["lo"]), 2)
    scored = orders.select(
        "o_orderkey", score.alias("score"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"),
    )
    return scored.withColumn("prediction", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round double columns so both engines print the same last digit."""
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")]
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in doubles}) if doubles else df
