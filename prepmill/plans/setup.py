"""Target analysis, balancing and splits."""

from pyspark.sql import functions as F

from ..operators import balance as B
from ..operators import split as S
from ..operators import target as T
from .base import query, rounded, table, view

HASH = "cast(concat('0x', substr(md5(concat_ws(':', {seed}, {keys})),1,15)) as bigint)"


def hash_sql(keys: str, seed: str = "42") -> str:
    cast = ", ".join(f"cast({k.strip()} as varchar)" for k in keys.split(","))
    return HASH.format(seed=f"'{seed}'", keys=cast)


def _target_sql(src: str, c: str, dtype: str, kind: str) -> str:
    return f"""select '{c}' as target, '{dtype}' as dtype, count(distinct {c}) as n_unique,
    {kind} as problem_type from {src}"""


FEW = "case when count(distinct {c}) <= 10 then 'classification' else 'regression' end"


@query(
    "s1_analyze_target",
    " union all ".join([
        _target_sql("lineitem", "l_returnflag", "string", "'classification'"),
        _target_sql("lineitem", "l_linenumber", "int", FEW.format(c="l_linenumber")),
        _target_sql("lineitem", "l_partkey", "bigint", FEW.format(c="l_partkey")),
        _target_sql("lineitem", "l_discount", "double", "'regression'"),
    ]))
def s1(spark, sf):
    line = table(spark, sf, "lineitem")
    parts = [T.analyze_target(line, c) for c in ("l_returnflag", "l_linenumber", "l_partkey", "l_discount")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _imbalance_sql(src: str, c: str) -> str:
    return f"""
with k as (select cast({c} as varchar) as c, count(*) as n from {src} where {c} is not null group by 1)
select count(*) as n_classes, max(n)*1.0/min(n) > 2 as is_imbalanced, round(cast(max(n) as double)/min(n), 6) as ratio,
 (select c from k order by n desc, c limit 1) as majority_class, (select c from k order by n, c limit 1) as minority_class,
 max(n) as majority_count, min(n) as minority_count from k"""


@query("s2_class_imbalance", _imbalance_sql("imb", "label"), ("imb",))
def s2(spark, sf):
    return rounded(T.class_imbalance(view(spark, sf, "imb"), "label"))


@query("s2_class_imbalance_labels", _imbalance_sql("labels", "quality"))
def s2b(spark, sf):
    return rounded(T.class_imbalance(table(spark, sf, "labels"), "quality"))


@query("s3_choose_features", """
with r as (select 'p_partkey' as feature, abs(corr(p_partkey, p_retailprice)) as v from part
 union all select 'p_size', abs(corr(p_size, p_retailprice)) from part)
select feature, cast(row_number() over (order by v desc, feature) - 1 as int) as place from r""")
def s3(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    chosen = T.choose_features(part, "p_retailprice", "auto", n=20)
    return spark.createDataFrame([(c, i) for i, c in enumerate(chosen)], "feature string, place int")


def _r(a: str, b: str) -> str:
    return f"abs(corr({a}, {b}))"


@query("s4_greedy_features", f"""
with c as (select {_r('l_quantity', 'l_extendedprice')} as q_e, {_r('q2', 'l_extendedprice')} as q2_e,
  {_r('l_quantity', 'q2')} as q_q2, {_r('l_discount', 'l_extendedprice')} as d_e,
  {_r('l_quantity', 'l_discount')} as q_d from line_clean),
 num as (select 'l_quantity' as feature, q_e as v from c where q_e >= q2_e or q_q2 < 0.8
   union all select 'q2', q2_e from c where q_q2 < 0.8 union all select 'l_discount', d_e from c where q_d < 0.8)
select feature, cast(row_number() over (order by v desc, feature) - 1 as int) as place from num
union all select 'l_returnflag', cast((select count(*) from num) as int)""", ("line_clean",))
def s4(spark, sf):
    line = view(spark, sf, "line_clean").select("l_quantity", "l_extendedprice", "l_discount", "q2", "l_returnflag")
    chosen = T.greedy_features(line, "l_extendedprice")
    return spark.createDataFrame([(c, i) for i, c in enumerate(chosen)], "feature string, place int")


@query("t2_split", f"""
select event_id, row_number() over (order by {hash_sql('event_id')}, event_id) <=
 ceil((select count(*) from events) * 0.2) as is_test from events""")
def t2(spark, sf):
    return S.mark_test(table(spark, sf, "events"), "event_id", 0.2).select("event_id", "is_test")


@query("t2_split_stratified", f"""
with k as (select event_id, label, row_number() over (partition by label order by {hash_sql('event_id')}, event_id) as r,
  count(*) over (partition by label) as n from imb)
select event_id, label, r <= floor(n*0.25 + 0.5) as is_test from k""", ("imb",))
def t2b(spark, sf):
    return S.mark_test(view(spark, sf, "imb"), "event_id", 0.25, "label").select("event_id", "label", "is_test")


@query("t2_split_hashed", f"""
select o_orderkey, cast({hash_sql('o_orderkey')} as double) / 1152921504606846976.0 < 0.3 as is_test from orders""")
def t2c(spark, sf):
    marked = S.mark_test(table(spark, sf, "orders"), "o_orderkey", 0.3, exact=False)
    return marked.select("o_orderkey", "is_test")


@query("t15_folds", f"""
with k as (select event_id, label, row_number() over (partition by label order by {hash_sql('event_id')}, event_id) as r,
  count(*) over (partition by label) as n from imb)
select event_id, label, cast((r > floor(n*1/5)) as int) + cast((r > floor(n*2/5)) as int)
 + cast((r > floor(n*3/5)) as int) + cast((r > floor(n*4/5)) as int) as fold from k""", ("imb",))
def t15f(spark, sf):
    return S.with_folds(view(spark, sf, "imb"), "event_id", 5, "label").select("event_id", "label", "fold")


@query("b3_undersample", f"""
with k as (select *, row_number() over (partition by label order by {hash_sql('event_id')}, event_id) as r from imb)
select event_id, user_id, label from k where r <= (select min(n) from (select count(*) as n from imb group by label))""",
       ("imb",))
def b3(spark, sf):
    return B.undersample(view(spark, sf, "imb").select("event_id", "user_id", "label"), "label", "event_id")


@query("x6_oversample", f"""
with c as (select label, count(*) as n from imb group by label), m as (select max(n) as mx from c),
 k as (select event_id, label, row_number() over (partition by label order by {hash_sql('event_id')}, event_id) as r from imb),
 t as (select event_id, label, (mx - n) // n + case when r <= (mx - n) % n then 1 else 0 end as extra from k join c using (label), m)
select event_id, label, unnest(range(0, cast(extra + 1 as bigint))) as copy from t""", ("imb",))
def x6(spark, sf):
    return B.oversample(view(spark, sf, "imb").select("event_id", "label"), "label", "event_id")


@query("b5_class_weights", """
select event_id, label, round((select count(*) from imb) / ((select count(distinct label) from imb) * cast(n as double)), 6) as weight
from imb join (select label, count(*) as n from imb group by label) using (label)""", ("imb",))
def b5(spark, sf):
    return rounded(B.with_class_weights(view(spark, sf, "imb").select("event_id", "label"), "label"))


@query("b6_positive_weight", """
select event_id, label, case when label = 1 then round((select count(*) from imb where label = 0) /
 cast((select count(*) from imb where label = 1) as double), 6) else 1.0 end as weight from imb""", ("imb",))
def b6(spark, sf):
    return rounded(B.with_positive_weight(view(spark, sf, "imb").select("event_id", "label"), "label"))


# Synthetic rows: nearest class neighbours, a hashed choice among them, a hashed step towards it.
MIX = """
 near as (select b.event_id, nb.event_id as other, row_number() over (partition by b.event_id
   order by (b.user_id-nb.user_id)*(b.user_id-nb.user_id) + (b.plen-nb.plen)*(b.plen-nb.plen), nb.event_id) as place,
   nb.user_id as ou, nb.plen as op from mino b join mino nb on b.event_id <> nb.event_id
   qualify place <= 5),
 made as (select event_id, unnest(range(1, cast(extra + 1 as bigint))) as copy, user_id, plen, label from base where extra > 0),
 pick as (select made.*, near.other, ou, op, cast({step} as double) / 1152921504606846976.0 as u from made
   join near on near.event_id = made.event_id and near.place = {pick} % 5 + 1),
 fake as (select event_id, copy, other as neighbor_id, round(user_id + (ou - user_id) * u, 6) as user_id,
   round(plen + (op - plen) * u, 6) as plen, label from pick)
select event_id, cast(0 as bigint) as copy, cast(null as bigint) as neighbor_id, cast(user_id as double) as user_id,
 cast(plen as double) as plen, label from imb
union all select * from fake
""".format(step=hash_sql("made.event_id, made.copy", "42:step"), pick=hash_sql("made.event_id, made.copy", "42:pick"))

SMOTE = f"""
with mino as (select * from imb where label = 1),
 c as (select (select count(*) from imb where label = 0) - (select count(*) from mino) as goal, (select count(*) from mino) as n),
 base as (select m.*, goal // n + case when row_number() over (order by {hash_sql('event_id')}, event_id) <= goal % n then 1 else 0 end as extra
   from mino m, c), {MIX}"""


@query("b1_smote", SMOTE, ("imb",))
def b1(spark, sf):
    return rounded(B.smote(view(spark, sf, "imb"), "label", ["user_id", "plen"], "event_id"))


@query("b2_adasyn", f"""
with mino as (select * from imb where label = 1),
 around as (select b.event_id, o.label as ol, row_number() over (partition by b.event_id
   order by (b.user_id-o.user_id)*(b.user_id-o.user_id) + (b.plen-o.plen)*(b.plen-o.plen), o.event_id) as place
   from mino b join imb o on b.event_id <> o.event_id qualify place <= 5),
 hard as (select event_id, sum(case when ol <> 1 then 1 else 0 end)/5.0 as r from around group by event_id),
 base as (select m.*, cast(round_even(r / (select sum(r) from hard) *
   ((select count(*) from imb where label = 0) - (select count(*) from mino)), 0) as bigint) as extra
   from mino m join hard using (event_id)), {MIX}""", ("imb",))
def b2(spark, sf):
    return rounded(B.adasyn(view(spark, sf, "imb"), "label", ["user_id", "plen"], "event_id"))


@query("b4_tomek_links", """
with n as (select a.event_id, a.label, arg_min(b.event_id, (a.user_id-b.user_id)*(a.user_id-b.user_id) + (a.plen-b.plen)*(a.plen-b.plen)
     + b.event_id / 1e9) as other
   from imb a join imb b on a.event_id <> b.event_id group by a.event_id, a.label)
select x.event_id, x.other as neighbor_id from n x join n y on x.other = y.event_id and y.other = x.event_id
where x.label <> y.label""", ("imb",))
def b4(spark, sf):
    return B.tomek_links(view(spark, sf, "imb"), "label", ["user_id", "plen"], "event_id")


@query("b4_smote_tomek")
def b4b(spark, sf):
    return rounded(B.smote_tomek(view(spark, sf, "imb"), "label", ["user_id", "plen"], "event_id"))
