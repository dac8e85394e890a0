"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from feedwright.llm import bpe, chunks, decontaminate, divergence, embeddings, language, licenses, minhash, pieces, pii, suffixes, toxicity, tries
from feedwright.llm.text import held_out, read

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Rank file of the byte-level vocabulary, and pattern of its pre-tokens; both are parameters of the operator.
RANKS = "byte_bpe_multi_50k.tiktoken"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.9)


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def span_figures(found: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256"
    )


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_figures(suffixes.dedup(read(spark, sf_dir, "documents"), length=50))


@query
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pii.detect(docs, pii.fit(docs), pii.FIGURES, pii.figures)


@query
def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), width=4, threshold=80)


def codec_digests(codec: bpe.Codec, ids: list[int]) -> tuple[int, str, str]:
    listed, decoded = codec.listed(ids).encode(), codec.decode(ids)
    return len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(decoded).hexdigest()


CODEC_FIELDS = [
    StructField("n_tokens", LongType()),
    StructField("ids_sha256", StringType()),
    StructField("decoded_sha256", StringType()),
]


@query
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.apply_codec(
        read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, CODEC_FIELDS, codec_digests
    )


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.dedup(read(spark, sf_dir, "documents"), sure=True)


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = read(spark, sf_dir, "documents"), held_out("doc_id", 5, 0)
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~held)
    return toxicity.score(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans"
    )


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = read(spark, sf_dir, "documents"), held_out("doc_id", 3, 1)
    model = language.fit(docs, train=~held)
    return language.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


#: Model file of the sentencepiece vocabulary, a parameter of the operator.
PIECES = "piece_bpe_32k.model"


def piece_digests(table: pieces.ChunkTable, ids) -> tuple[int, str, str]:
    listed, decoded = table.listed(ids).encode(), table.decode(ids).encode()
    return len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(decoded).hexdigest()


@query
def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.apply_table(read(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), CODEC_FIELDS, piece_digests)


@query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(read(spark, sf_dir, "conversations")).drop("node")


_SQL_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""

ORACLES["op10_decontamination"] = f"""
with d as (select doc_id, {_SQL_WORDS} as w from documents),
b as (select item_id, {_SQL_WORDS} as w from benchmark),
patterns as (
  select distinct item_id, least(len(w), 10) as m, array_to_string(w[i:i + 9], ' ') as p
  from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) as i from b where len(w) > 0)),
lengths as (select distinct m from patterns),
places as (
  select doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') as p
  from (select doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) as i from d, lengths where len(w) >= m)),
hits as (select doc_id, item_id, i, m from places join patterns using (m, p)),
words as (select doc_id, count(distinct k) as n_hit
          from (select doc_id, unnest(generate_series(i, i + m - 1)) as k from hits) group by doc_id),
found as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids
          from hits group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join found using (doc_id)"""

# Pairs come from an inverted index over shingles; components by a recursive walk over the links.
ORACLES["op5_minhash"] = r"""
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 3], ' ') as g
  from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
links as (
  select x.doc_id as a, y.doc_id as b from s x join s y on x.g = y.g and x.doc_id <> y.doc_id
  join n p on p.doc_id = x.doc_id join n q on q.doc_id = y.doc_id
  group by x.doc_id, y.doc_id, p.n, q.n having 100 * count(*) >= 80 * (p.n + q.n - count(*))),
reach as (select doc_id, doc_id as node from documents union select reach.doc_id, b from reach join links on a = node)
select doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, min(node) as component_id, doc_id = min(node) as kept
from reach left join n using (doc_id) group by doc_id"""

ORACLES["op1_embedding_near_dedup"] = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where list_sum(list_transform(embedding, lambda x: x::double * x)) > 0),
u as (select vec_id, e, sqrt(list_inner_product(e, e)) as s from v),
links as (
  select x.vec_id as a, y.vec_id as b from u x join u y on x.vec_id <> y.vec_id
  where list_inner_product(x.e, y.e) / (x.s * y.s) >= 0.9),
reach as (select vec_id, vec_id as node from embeddings union select reach.vec_id, b from reach join links on a = node)
select vec_id, (select count(*) from links where a = vec_id) as n_links, min(node) as component_id,
  vec_id = min(node) as kept
from reach group by vec_id"""

# Every kept term of a language meets every ordered pair of its sources.
ORACLES["op11_source_divergence"] = r"""
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from documents),
w as (select r, lang, source, unnest(w) as term from d),
kept as (select lang, term from w group by lang, term having count(distinct r) >= 3),
c as (select lang, source, term, count(*) as n from w join kept using (lang, term) group by all),
groups as (select distinct lang, source from d),
v as (select lang, count(*) as v from kept group by lang),
sizes as (select lang, source, coalesce(sum(n), 0)::hugeint + any_value(v) as size
  from groups join v using (lang) left join c using (lang, source) group by lang, source),
p as (select lang, source, term, coalesce(n, 0) as n, 1 + (1000000000 * (coalesce(n, 0)::hugeint + 1)) // size as p
  from sizes join kept using (lang) left join c using (lang, source, term)),
q as (select lang, term, 1 + (1000000000 * (sum(n)::hugeint + 1)) // any_value(size) as q
  from p join (select lang, sum(n)::hugeint + any_value(v) as size from c join v using (lang) group by lang) using (lang)
  group by lang, term),
pair as (
  select x.lang, x.source, y.source as item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) as value
  from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join pair on pair.lang = a.lang and pair.source = a.source and pair.item = b.source),
raised as (
  select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // q)::bigint as value
  from p join q using (lang, term) where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::integer as rank
  from (select * from pairs union all select * from raised))
select * from ranked where part = 'pair' or rank <= 200"""

# crc32 bit by bit; a node is the digest of the digests of its turns; its ancestors are the prefixes of its smallest member.
ORACLES["op13_conversation_trie"] = """
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as k
  from conversations where conv_id is not null),
c as (
  select conv_id, conv_id - conv_id % 100 as opener, xor(4294967295, list_reduce(
    list_prepend(4294967295, flatten(list_transform(string_split(conv_id::varchar, ''), lambda x: [ord(x)::bigint, 0, 0, 0, 0, 0, 0, 0]))),
    lambda crc, x: xor(xor(crc, x) >> 1, 3988292384 * (xor(crc, x) & 1)))) % 6 as h
  from (select distinct conv_id from t)),
m as (
  select conv_id, opener, h, least(h, found) as lead
  from (select c.conv_id, opener, h, count(k) as found from c left join t on t.conv_id = opener group by c.conv_id, opener, h)),
r as (
  select m.conv_id, k + 1 as depth, role, text from m join t on t.conv_id = opener and k < h
  union all
  select m.conv_id, lead + k - h + 1, role, text from m join t on t.conv_id = m.conv_id and k >= h),
p as (
  select conv_id, depth, length(text) as chars,
    string_agg(sha256(length(role) || ':' || role || text), '') over (partition by conv_id order by depth) as path from r
  union all select conv_id, 0, 0, '' from c),
n as (select path, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(chars) as chars from p group by path, depth),
kids as (select left(path, length(path) - 64) as path, count(*) as n_children from n where depth > 0 group by all),
whole as (select n.*, coalesce(n_children, 0) as n_children from n left join kids using (path)),
below as (
  select top.path, count(*) filter (n_children = 0) as n_leaves, sum((n_convs - 1) * x.chars)::bigint as saved_tokens
  from whole x join p top on top.conv_id = x.conv_id and top.depth <= x.depth group by top.path),
ends as (
  select path, string_agg(conv_id::varchar, ',' order by conv_id) as ids
  from (select conv_id, arg_max(path, depth) as path from p group by conv_id) group by path)
select w.conv_id, w.depth, up.conv_id as parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens,
  sha256(coalesce(ids, '')) as ends_sha256
from whole w join below using (path) left join ends using (path)
left join n up on w.depth > 0 and up.path = left(w.path, length(w.path) - 64)"""
