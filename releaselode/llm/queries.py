"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, bpe, gru, jaccard, media, packing, quality, records, runs, sharding, suffix, warc, word_bpe
from .common import tokenizer_path

SHARDS = [f"shard-{i:03d}" for i in range(64)]
TABLE_SIZE = 8191


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(_table(spark, sf_dir, "documents")).drop("features")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_digest(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_digest(_table(spark, sf_dir, "documents"))


def op5_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.divergence_rules(_table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def op6_framed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.record_digest(_table(spark, sf_dir, "documents")).drop("part", "serial", "seq")


def op7_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").selectExpr("doc_id", "cast(octet_length(coalesce(text, '')) as bigint) as n_bytes")
    return sharding.place(docs, "doc_id", SHARDS, TABLE_SIZE)


def op8_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digest(_table(spark, sf_dir, "pages"))


def op10_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru.document_scores(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(_table(spark, sf_dir, "documents"), runs.planted_words, full=False)


def op13_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.encode_digest(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), with_ids=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_media_features, op2_jaccard_join, op3_byte_bpe, op4_suffix_dedup, op5_divergence_rules, op6_framed_records, op7_lookup_sharding, op8_bin_slack_packing, op9_warc_bundles, op10_recurrent_lm, op11_filter_audit, op12_periodic_runs, op13_speculative_bpe)
}


def _sharding_sql() -> str:
    table = ", ".join(map(str, sharding.lookup_table(SHARDS, TABLE_SIZE)))
    return f"""
with t as (select [{table}] as slots),
d as (select doc_id, cast(octet_length(encode(coalesce(text, ''))) as bigint) as n_bytes,
        cast(cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 8) as bigint) % {TABLE_SIZE} as bigint) as slot from documents)
select doc_id, n_bytes, slot, 'shard-' || lpad(cast(slots[slot + 1] as varchar), 3, '0') as shard from d, t"""


#: Without payload deduplication by groups there is no archive in SQL; what the archive must say is expressible.
WARC_SQL = """
with p as (select page_id, coalesce(html, '') as body, max(page_id) over (partition by coalesce(html, '')) as top from pages),
h as (select *, unhex(sha1(body)) as raw from p),
b as (select *, [get_bit(cast(raw as bit), cast(i as integer)) for i in range(160)] as bits from h)
select page_id, cast(octet_length(encode(body)) as bigint) as payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * bits[5*i+1] + 8 * bits[5*i+2] + 4 * bits[5*i+3] + 2 * bits[5*i+4] + bits[5*i+5], 1) for i in range(32)], '') as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id = top then null else top end as refers_to from b"""


def oracle_sql() -> dict[str, str]:
    return {"op5_divergence_rules": quality.oracle_sql(), "op7_lookup_sharding": _sharding_sql(), "op9_warc_bundles": WARC_SQL, "op11_filter_audit": audit.ORACLE_SQL}
