"""Queries over the corpus operators: op number and name to a function of (spark, sf_dir)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoengine.llm import langid, lm, mixing, ogg, pieces, quality, simhash, topk, toxicity, warc
from geoengine.llm.common import utf8
from geoengine.session import durable, shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


ORACLE["op1_exact_topk"] = """
with v as (
  select vec_id, [cast(floor(1024 * cast(x as double)) as bigint) for x in embedding] as e
  from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id,
         cast(list_inner_product(cast(q.e as double[]), cast(c.e as double[])) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 100 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
where rank <= 10
"""


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), check=True)
    return found.select("doc_id", F.size("ids").alias("n_ids"), "ids", "lossless")


@query
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


@query
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.draws(table(spark, sf_dir, "documents"))
    return drawn.select(
        "doc_id",
        F.col("__m_size").alias("size"),
        F.col("__m_source_size").alias("source_size"),
        F.col("__m_target").alias("target"),
        (F.col("__m_size") * F.size("__m_shards")).alias("taken"),
        F.col("__m_shards").alias("shards"),
    )


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


@query
def op8_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stored = ogg.encode(docs.select("doc_id", F.octet_length(utf8()).cast("long").alias("n_bytes"), ogg.text_payload().alias("p")).select("doc_id", "n_bytes", "p"), F.col("p")).drop("p")
    # the files are written to the shared folder and read back
    folder = f"{shared_folder(spark)}/ogg-{uuid.uuid4().hex}"
    stored.write.option("compression", "zstd").parquet(folder)
    back = ogg.decode(spark.read.parquet(folder))
    feature = F.format_string("streams=%d;pages=%d;packets=%d;seconds=%.6f;mean=%.6f;skipped=%d;lost=%d", "streams", "pages", "packets", "seconds", "mean", F.size("skipped"), "lost")
    return back.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), ogg.tail_crc32(F.col("payload")).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"))


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = durable(warc.archives(warc.planned(table(spark, sf_dir, "pages"))))
    records = warc.read_archives(files).where("kind = 'record'")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op10_warc"] = """
with p as (
  select page_id, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as digest from pages
), f as (select digest, min(page_id) as first from p where n >= 100 group by digest)
select p.page_id, cast(p.n as bigint) as payload_bytes, p.digest as payload_digest,
       case when f.first is null or f.first = p.page_id then 'response' else 'revisit' end as record_type,
       case when f.first <> p.page_id then f.first end as refers_to
from p left join f on f.digest = p.digest
"""
