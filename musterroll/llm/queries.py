"""One query per operator of the subpackage, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from musterroll.llm import bpe, divergence, lines, mixing, packing, passages, quality, ranking, secrets, shards, simhash, topk, urls
from musterroll.llm.common import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op2_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents")).drop("text_hash")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op4_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = lines.deduped(table(spark, sf_dir, "documents"))
    return rest.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.sharded(table(spark, sf_dir, "documents"))


def op7_certified_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    digest = F.sha2("base", 256).alias("base_sha256")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", digest, "spans", "n_layers", "incomplete")


def op10_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_geometric_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


CATALOGUE = {
    q.__name__: q
    for q in (
        op1_byte_bpe,
        op2_passage_dedup,
        op3_url_filter,
        op4_threshold_topk,
        op5_line_dedup,
        op6_virtual_slots,
        op7_certified_rules,
        op8_simhash_dedup,
        op9_secret_scan,
        op10_fair_mix,
        op11_geometric_blocks,
        op12_mixture_packing,
        op13_source_divergence,
    )
}

ORACLE = {
    "op4_threshold_topk": topk.SQL,
    "op5_line_dedup": lines.SQL,
    "op10_fair_mix": mixing.SQL,
    "op11_geometric_blocks": ranking.SQL,
    "op13_source_divergence": divergence.SQL,
}
