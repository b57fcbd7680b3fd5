"""Queries over the test tables, one per operator, each with SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, collocations, conversation_trie, exact_dedup, fingerprints, near_dedup, packing, quality_classifier, quality_rules, sharding,
    suffix_dedup, url_filter, warc,
)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def tokenizer_file(name: str) -> str:
    """Where the public tokenizer files are on the driver."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


RULES_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents
), g as (
  select doc_id, unnest(range(len(w) - 2)) as i, w from d where len(w) > 2
), t as (
  select doc_id, i, count(*) over (partition by doc_id, w[i + 1], w[i + 2], w[i + 3]) as c from g
), r as (
  select doc_id, count(distinct p) as n_repeat_words
  from (select doc_id, unnest([i, i + 1, i + 2]) as p from t where c > 1) group by doc_id
), m as (
  select d.doc_id, cast(len(w) as bigint) as n_words,
    cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
    cast(len(l) as bigint) as n_lines,
    cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words
  from d left join r on d.doc_id = r.doc_id
), b as (
  select *, cast(
      (case when n_words < 50 then 1 else 0 end)
    + (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end)
    + (case when 10 * n_symbols > n_words then 4 else 0 end)
    + (case when 10 * n_dup_lines > 6 * n_lines then 8 else 0 end)
    + (case when word_chars < 2 * n_words then 16 else 0 end)
    + (case when word_chars > 20 * n_words then 32 else 0 end) as int) as fail_bits
  from m
)
select *, fail_bits % 4 <> 0 as base_failed, 3 as policy, fail_bits = 0 as kept from b
"""


@query("op1_quality_rules", RULES_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


@query("op2_quality_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no URL: its source stands for the host, its language for the path."""
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    return quality_classifier.classify(docs, labels, host=F.col("source"), path=F.col("lang"))


@query("op3_bpe_automaton")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("byte_bpe_50k.json")
    return bpe.digests(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path))


URLS_SQL = """
with r as (
  select * from (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
    ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) as v(verdict, host, path)
), u as (
  select page_id,
    case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), s as (
  select page_id,
    translate(regexp_extract(rest, '^[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') as path from u
), m as (
  select page_id, s.host, s.path, r.host || r.path as rule, r.verdict,
    row_number() over (partition by page_id order by length(r.host || r.path) desc) as k
  from s left join r on (s.host = r.host or ends_with(s.host, '.' || r.host)) and starts_with(s.path, r.path)
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from m where k = 1
"""


@query("op4_url_filter", URLS_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


WARC_SQL = """
with p as (
  select page_id, coalesce(html, '') as html, min(page_id) over (partition by coalesce(html, '')) as first from pages
), h as (
  select *, sha1(html) as hex from p
)
select page_id, cast(strlen(html) as bigint) as payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(
    ((cast('0x' || substr(hex, cast(1 + 5 * (k // 4) as bigint), 5) as bigint) >> cast(15 - 5 * (k % 4) as bigint)) & 31) as bigint
  ), 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from h
"""


@query("op5_warc", WARC_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


@query("op6_suffix_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.passage_digests(suffix_dedup.repeated_passages(table(spark, sf_dir, "documents")))


@query("op7_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


@query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")))


COPIES_SQL = r"""
with n as (
  select doc_id, length(coalesce(text, '')) as chars,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as norm from documents
), g as (
  select doc_id, sha256(norm) as text_sha256,
    first_value(doc_id) over (partition by norm order by chars desc, doc_id) as keep_id,
    count(*) over (partition by norm) as group_size from n
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g
"""


@query("op9_exact_dedup", COPIES_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("bucket")


def _jump_sql(shards: int) -> str:
    """The jump loop of the published algorithm, unrolled, over unsigned 64-bit arithmetic in hugeint."""
    steps = [f"j0 as (select doc_id, cast(doc_id as hugeint) + (case when doc_id < 0 then {2**64}::hugeint else 0 end) as k, "
             "-1 as b, 0 as j from documents)"]
    for s in range(shards):
        steps.append(
            f"k{s} as (select doc_id, k, b, j, (k * 2862933555777941757::hugeint + 1) % {2**64}::hugeint as x from j{s}), "
            f"j{s + 1} as (select doc_id, x as k, case when j < {shards} then j else b end as b, "
            f"case when j < {shards} then cast(floor(cast(j + 1 as double) * (2147483648.0::double / "
            f"cast(x // {2**33}::hugeint + 1 as double))) as bigint) else j end as j from k{s})"
        )
    return f"with {', '.join(steps)} select doc_id, cast(b as int) as shard from j{shards}"


def _crc_table() -> str:
    """The 256 remainders of the standard CRC-32 polynomial, from its rule."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    return f"{table}::bigint[]"


SHARDS_SQL = f"""
with a as ({_jump_sql(16)}), c as ({_jump_sql(17)}),
d as (
  select doc_id, cast(strlen(coalesce(text, '')) + 1 as bigint) as size,
    list_transform(list_filter(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g'), ' '),
      lambda h: h <> ''), lambda h: cast('0x' || h as bigint)) as bytes from documents
), s as (
  select doc_id, size, xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, bytes),
    lambda x, y: xor(({_crc_table()})[(xor(x, y) & 255) + 1], x >> 8))) as text_crc32 from d
)
select s.doc_id, size, text_crc32, 'key' as law, a.shard,
  cast(row_number() over (partition by a.shard order by s.doc_id) - 1 as bigint) as slot, c.shard as grown_shard
from s join a on a.doc_id = s.doc_id join c on c.doc_id = s.doc_id
"""


@query("op10_sharding", SHARDS_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 16)


PHRASES_SQL = r"""
with p as (
  select coalesce(lang, 'und') as lang, unnest(list_transform(
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]'),
    lambda x: list_filter(string_split_regex(x, '[\x20\x09]+'), lambda y: y <> ''))) as w
  from documents
), o as (
  select lang, 1 as m, unnest(w) as phrase from p
  union all select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from p
  union all select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from p
), f as (
  select lang, m, phrase, count(*) as c from o group by lang, m, phrase having count(*) >= 10
), n as (
  select lang, count(*) as n from o where m = 1 group by lang
), s as (
  select lang, m, phrase, c as a, string_split(phrase, ' ') as w from f where m > 1
), cuts as (
  select lang, m, phrase, a, k, array_to_string(w[1:k], ' ') as x, array_to_string(w[k + 1:], ' ') as y
  from (select *, unnest(range(1, m)) as k from s)
), scored as (
  select cuts.lang, cuts.m, cuts.phrase, a, k, fx.c as l, fy.c as r,
    cast((1000000::hugeint * a * a) // (fx.c::hugeint * fy.c) as bigint) as score
  from cuts join f fx on fx.lang = cuts.lang and fx.phrase = x join f fy on fy.lang = cuts.lang and fy.phrase = y
), best as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), inside as (
  select lang, phrase, max(a) as most from (
    select lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) as phrase from s where m = 3
  ) group by lang, phrase
), kept as (
  select best.* from best left join inside on inside.lang = best.lang and inside.phrase = best.phrase
  where most is null or 100 * most < 50 * a
)
select kept.lang, row_number() over (partition by kept.lang order by score desc, a desc, phrase) as rank,
  phrase, a, l, r, n, score
from kept join n on n.lang = kept.lang
qualify rank <= 2000
"""


@query("op11_collocations", PHRASES_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


TRIE_SQL = f"""
with t as (
  select conv_id, strlen(coalesce(text, '')) as b, turn,
    md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as id
  from conversations where conv_id is not null
), x as (
  select conv_id, id, b, row_number() over (partition by conv_id order by turn nulls first, id) - 1 as pos from t
), c as (
  select conv_id, count(*) as own, conv_id - conv_id % 5 as base,
    xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(conv_id::varchar) + 1),
      lambda i: cast(ascii(substr(conv_id::varchar, i, 1)) as bigint))),
      lambda p, q: xor(({_crc_table()})[(xor(p, q) & 255) + 1], p >> 8))) % 9 as h
  from x group by conv_id
), g as (
  select c.*, least(c.h, coalesce(z.own, 0)) as graft from c left join c z on z.conv_id = c.base
), r as (
  select g.conv_id, x.pos, x.id, x.b from g join x on x.conv_id = g.base and x.pos < g.h
  union all select g.conv_id, x.pos - g.h + g.graft, x.id, x.b from g join x on x.conv_id = g.conv_id and x.pos >= g.h
), l as (
  select g.conv_id, coalesce(list(r.id order by r.pos) filter (r.id is not null), []) as ids,
    coalesce(list(r.b order by r.pos) filter (r.id is not null), []) as bs
  from g left join r on r.conv_id = g.conv_id group by g.conv_id
), p as (
  select conv_id, ids, bs, unnest(range(len(ids) + 1)) as depth from l
), k as (
  select conv_id, depth, md5(array_to_string(ids[1:depth], ',')) as key, depth = len(ids) as ends, ids[depth] as id, bs[depth] as b from p
), n as (
  select depth, key, min(conv_id) as conv_id, count(*) as n_convs, min(id) as id, min(b) as b,
    string_agg(conv_id::varchar, ',' order by conv_id) filter (ends) as members
  from k group by depth, key
), u as (
  select n.depth, n.key, n.conv_id, a.depth as up_depth, a.key as up_key,
    (n.n_convs - 1) * coalesce(n.b, 0) as saved from n join k a on a.conv_id = n.conv_id and a.depth <= n.depth
), kids as (
  select up_depth as depth, up_key as key, count(*) as n_children from u where up_depth = depth - 1 group by up_depth, up_key
), below as (
  select up_depth as depth, up_key as key, sum(saved) as saved_tokens, count(*) filter (kids.key is null) as n_leaves
  from u left join kids on kids.depth = u.depth and kids.key = u.key group by up_depth, up_key
)
select n.conv_id, n.depth, up.conv_id as parent_conv_id, n.id as turn_id, n.n_convs, coalesce(n_children, 0) as n_children,
  n_leaves, cast(saved_tokens as bigint) as saved_tokens, sha256(coalesce(n.members, '')) as ends_sha256
from n join below on below.depth = n.depth and below.key = n.key
left join kids on kids.depth = n.depth and kids.key = n.key
left join k a on a.conv_id = n.conv_id and a.depth = n.depth - 1
left join n up on up.depth = a.depth and up.key = a.key
"""


@query("op12_conversation_trie", TRIE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))


@query("op13_winnowing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.digests(fingerprints.compare_edited(table(spark, sf_dir, "documents")))
