"""Queries of the operators, one per operator, over whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaysight.llm import (
    bpe,
    centroids,
    chat_format,
    decontaminate,
    impact_index,
    lm_score,
    mixture,
    norm_buckets,
    parity_join,
    pii,
    sql,
    toxicity,
    url_rules,
    virtual_slots,
)
from quaysight.llm.common import table


# A conversation whose texts hold control strings.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op1_schema_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, a JSON record in another
    layout, formatted and read back."""
    record = json.dumps({"messages": [{"role": role, "content": CONTROL_TEXT} for role in ("user", "assistant")]})
    extra = spark.createDataFrame([(-7, record)], "conv_id long, record string")
    turns = chat_format.canonical_turns(table(spark, sf_dir, "conversations")).unionByName(
        chat_format.canonical_json_turns(extra).drop("layout"))
    return chat_format.digests(chat_format.format_conversations(turns))


def op2_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return parity_join.near_duplicate_components(table(spark, sf_dir, "documents"))


def op3_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of all documents, good against all."""
    return lm_score.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_impact_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best inner products of every hundredth vector with all others."""
    return impact_index.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, scale=1024)


def op5_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of all documents with all benchmark items."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")


def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    records, _ = virtual_slots.shard(table(spark, sf_dir, "documents"))
    return records.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                          F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op7_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op8_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category probabilities and the toxic decision for all documents."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


# Rules of the query.
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op9_sorted_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


def op10_budget_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents to source weights 5, 2, 1."""
    mixed = mixture.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                        F.col("mix_target").alias("target"),
                        (F.col("mix_size") * F.col("mix_times")).cast("long").alias("taken"), "source")


def op11_prefix_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents under the public byte-level vocabulary, and the
    texts read back from them."""
    import public_tokenizers

    tokens = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), decoded=True)
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                         F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                         F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_zone_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of 64 finite components around 40 centroids."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents of every benchmark item, of all documents."""
    return norm_buckets.top_k(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_schema_fingerprint, op2_parity_join, op3_cross_entropy, op4_impact_ordered, op5_spaced_seeds, op6_virtual_slots,
        op7_weak_supervision, op8_classifier_chain, op9_sorted_sweep, op10_budget_fit,
        op11_prefix_dp, op12_zone_maps, op13_norm_buckets)
}

ORACLE_SQL: dict[str, str] = {
    "op1_schema_fingerprint": sql.op1_schema_fingerprint(CONTROL_TEXT),
    "op4_impact_ordered": sql.OP4_IMPACT_ORDERED,
    "op12_zone_maps": sql.op12_zone_maps(),
    "op13_norm_buckets": sql.OP13_NORM_BUCKETS,
    # URL_RULES, the longest first
    "op9_sorted_sweep": r"""
WITH urls AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
  FROM pages),
ruled AS (
  SELECT page_id, host, path, CASE
    WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM urls)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""",
}
