"""The queries that apply each corpus operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm import bpe, crosspolytope, decontaminate, fmindex, huffman, licenses, minhash, suffixarray, toxicity, urls
from tamarack.llm.urls import Rule

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query
def op10_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = huffman.write_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return huffman.checksums(huffman.read(spark, path))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The rules that op7's contract names.
URL_RULES = [
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
]


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffixarray.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fmindex.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


#: Components of ``links``, for the SQL below.
_REACH = """
, ways(a, b) as (select a, b from links union all select b, a from links)
, reach(node, other) as (select {key}, {key} from {rows} union select r.node, w.b from reach r join ways w on w.a = r.other)
, roots as (select node, min(other) as component_id from reach group by node)"""

#: DuckDB SQL for the same rows, where SQL can express them: windows, sets and pairs by their definitions.
ORACLES: dict[str, str] = {
    "op2_suffix_array": """
with docs as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as raw from documents)
, hexed as (select r, doc_id, octet_length(raw) as n, hex(raw) as h from docs)
, parts as (select r, b, substr(h, 2 * b + 1, 2 * (1024 + 199)) as part from hexed, unnest(range(0, greatest(n - 199, 0), 1024)) as u(b))
, windows as (select r, b + i as pos, substr(part, 2 * i + 1, 400) as w from parts, unnest(range(0, least(1024, length(part) // 2 - 199))) as u(i))
, again as (select sha256(w) as k from windows group by 1 having count(*) > 1)
, found as (select r, pos, pos > lag(pos, 1, -1000) over (partition by r order by pos) + 200 as fresh from windows where sha256(w) in (select k from again))
, numbered as (select r, pos, sum(fresh::int) over (partition by r order by pos) as span from found)
, spans as (select r, span, min(pos) as a, max(pos) + 200 as b from numbered group by r, span)
, cut as (select r, list(struct_pack(a := a, b := b) order by a) as s, count(*) as n_spans, sum(b - a) as gone from spans group by r)
, kept as (select h.doc_id, h.n, coalesce(c.gone, 0) as gone, coalesce(c.n_spans, 0) as n_spans,
    case when c.s is null then h.h else array_to_string(list_transform(range(0, len(c.s) + 1), lambda k: substr(h.h, 2 * (case when k = 0 then 0 else c.s[k].b end) + 1,
      2 * ((case when k = len(c.s) then h.n else c.s[k + 1].a end) - (case when k = 0 then 0 else c.s[k].b end)))), '') end as k
    from hexed h left join cut c using (r))
select doc_id, n::bigint as n_bytes, gone::bigint as n_removed, n_spans::bigint as n_spans, sha256(unhex(k)) as kept_sha256 from kept""",
    "op4_minhash": """
with recursive docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents)
, sets as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s from docs, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as u(i) where len(w) > 0)
, sizes as (select doc_id, count(*) as n from sets group by doc_id)
, shared as (select x.doc_id as a, y.doc_id as b, count(*) as k from sets x join sets y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2)
, links as (select a, b from shared join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * k >= 75 * (p.n + q.n - k))"""
    + _REACH.format(key="doc_id", rows="documents")
    + """
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
from documents d left join sizes using (doc_id) join roots on node = d.doc_id""",
    "op8_fm_index": """
with docs as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents)
, windows as (select r, i, md5(array_to_string(w[i : i + 34], ' ')) as k from docs, unnest(range(1, len(w) - 33)) as u(i))
, again as (select k from windows group by k having count(*) > 1)
, gone as (select distinct r, p from windows, unnest(range(i, i + 35)) as u(p) where k in (select k from again))
, words as (select r, p, w[p] as word from docs, unnest(range(1, len(w) + 1)) as u(p))
, kept as (select r, string_agg(word, ' ' order by p) as t, count(*) as n from words anti join gone using (r, p) group by r)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from docs left join kept using (r)""",
    "op9_cross_polytope": """
with recursive vectors as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0)
, links as (select x.vec_id as a, y.vec_id as b from vectors x join vectors y on x.label = y.label and len(x.v) = len(y.v) and x.vec_id < y.vec_id
  where list_cosine_similarity(x.v, y.v) >= 0.98)"""
    + _REACH.format(key="vec_id", rows="embeddings")
    + """
, degrees as (select a as node, count(*) as n from ways group by a)
select e.vec_id, coalesce(n, 0)::bigint as n_links, component_id, e.vec_id = component_id as kept
from embeddings e join roots l on l.node = e.vec_id left join degrees g on g.node = e.vec_id""",
}
