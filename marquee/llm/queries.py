"""Registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, block_naming, bpe, collocations, jaccard_join, licenses, near_dup, packing, pii, quality, repeats, topk, warc

QUERIES = {}
ORACLE = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(_table(spark, sf_dir, "pages"))


ORACLE["op7_warc"] = f"""
with p as (select page_id, coalesce(html, '') as html from pages),
f as (select *, min(page_id) over (partition by html) as first_id, sha1(html) as h from p)
select page_id, octet_length(encode(html))::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{warc.BASE32}',
    (((('0x' || substr(h, ((i // 4) * 5 + 1)::bigint, 5))::bigint >> (15 - 5 * (i % 4))) & 31) + 1)::bigint, 1)), '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from f"""


@query
def op8_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_dedup(_table(spark, sf_dir, "documents"))


ORACLE["op8_block_naming"] = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
  doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))"""


@query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents")).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


@query
def op4_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op6_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ints = topk.integers(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(ints, ints.where("vec_id % 20 = 0"), 20)


ORACLE["op6_norm_buckets"] = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
      from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20"""


@query
def op9_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def _license_oracle() -> str:
    rows = ", ".join(f"({k}, '{name}', {len(g)}, [{', '.join(repr(x) for x in g)}])"
                     for k, (name, g) in enumerate((n, licenses.bigrams(t)) for n, t in licenses.TEMPLATES.items()))
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with t(k, license, n, grams) as (values {rows}),
l as (select rowid_, doc_id, str_split(txt, chr(10)) as lines, txt from
      (select row_number() over () as rowid_, doc_id, {lower} as txt from documents)),
u as (select rowid_, unnest(range(len(lines))) as unit, unnest(lines) as unit_text from l
      union all select rowid_, -1, txt from l where len(lines) > 1),
w as (select rowid_, unit, regexp_extract_all(unit_text, '[a-z0-9]+') as w from u),
b as (select rowid_, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from w where len(w) > 1),
m as (select rowid_, unit, k, license, 2 * len(list_intersect(g, grams)) / (len(g) + n)::double as dice
      from b join t on 2 * least(len(g), n) * 100 >= {licenses.THRESHOLD} * (len(g) + n)),
h as (select rowid_, unit, arg_min(license, (-dice, k)) as license, max(dice) as dice, arg_min(k, (-dice, k)) as k
      from m where dice >= {licenses.THRESHOLD} / 100.0 group by all),
d as (select rowid_, count(*) as n_matches, arg_min(license, (-dice, k, case when unit < 0 then 1e12 else unit end)) as license, max(dice) as dice,
      arg_min(unit, (-dice, k, case when unit < 0 then 1e12 else unit end)) as unit from h group by all)
select doc_id, coalesce(n_matches, 0)::bigint as n_matches, license, round(dice, 6) as dice, unit::bigint as unit
from l left join d using (rowid_)"""


ORACLE["op9_license_dice"] = _license_oracle()


@query
def op1_bilstm_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs))
    return found.select("doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")


@query
def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


@query
def op3_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


@query
def op11_lockstep_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(_table(spark, sf_dir, "documents"))


@query
def op12_fm_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


ORACLE["op12_fm_collocations"] = collocations.oracle()


@query
def op13_universe_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(_table(spark, sf_dir, "documents"))
