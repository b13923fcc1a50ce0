"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.llm import ann, byte_bpe, centroids, chat, html_text, oracle, packing, prefix_trie, quality_cnn, quality_rules, secrets, sharding, simhash, warc
from chronopanel.llm.common import new_path, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), RANKS)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op3_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_cnn.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_cnn.score(docs, model)
    return scored.select("doc_id", quality_cnn.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.round_trip(table(spark, sf_dir, "documents"), RANKS)
    return coded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shuffle_shards(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        sharding.row_bytes().alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit(sharding.LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.BASE]
    of_base = F.filter("spans", lambda x: x["kind"].isin(base))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint")
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in base], F.sha2(text(of_base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.clean(table(spark, sf_dir, "documents")).select("doc_id", *quality_rules.MEASURES, "base_failed", "kept", F.round("lost", 6).alias("lost"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


OPERATORS = (
    op1_packing, op2_ann, op3_quality_cnn, op4_byte_bpe, op5_sharding, op6_secrets, op7_simhash, op8_warc, op9_chat_formatting, op10_quality_rules,
    op11_html_extraction, op12_conversation_prefix_trie, op13_centroid_clustering,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_secrets": oracle.secrets_sql(), "op8_warc": oracle.warc_sql(), "op9_chat_formatting": oracle.chat_sql(), "op10_quality_rules": oracle.rules_sql(),
        "op12_conversation_prefix_trie": oracle.trie_sql(), "op13_centroid_clustering": oracle.centroids_sql(),
    }
