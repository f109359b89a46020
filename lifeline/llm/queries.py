"""One query per operator over its whole table, and the SQL that checks it where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifeline.llm import (
    conversation_repair, decontaminate, html_extraction, license_scan, mixing, ngram_join, pii_crf, quality_rules, rule_ensemble, secret_scan, sharding,
    source_audit, suffix_dedup,
)

SHARDS = tuple(f"shard-{i:03d}" for i in range(32))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_bad_punctuation", "n_navigation", "n_boilerplate", "line_chars", "clean_chars")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, SHARDS)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    # The documents have no paths: sources, languages and groups of ids serve as directories.
    parts = ("source",), ("source", "lang"), ("source", "lang", F.floor(F.col("doc_id") / 3000).cast("string"))
    paths = [F.concat_ws("/", *p, F.col("doc_id").cast("string")) for p in parts]
    depth = F.pmod("doc_id", F.lit(3))
    path = F.when(depth == 0, paths[0]).when(depth == 1, paths[1]).otherwise(paths[2])
    return license_scan.scan(docs, path, file_share=0.1)


def op4_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii_crf.find_personal(docs, pii_crf.default_field(docs))

    def joined(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id", *[F.size(_of_kind("pii_base", k)).cast("long").alias(f"n_{k}") for k in pii_crf.KINDS],
        F.sha2(joined("pii_base"), 256).alias("base_sha256"), joined("pii_spans").alias("spans"))


def _of_kind(spans: str, kind: str):
    return F.filter(spans, lambda s: s["kind"] == kind)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.similar_groups(table(spark, sf_dir, "documents"), n=3, percent=90)
    return found.select(
        F.col("id").alias("doc_id"), F.col("n_shingles").cast("long").alias("n_shingles"),
        F.col("component").alias("component_id"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=200)
    return found.withColumnRenamed("id", "doc_id")


# Domains of the labelled table (quality, toxic), and the token shares wanted of them.
DOMAINS = (("1", "0"), ("1", "1"), ("0", "0"), ("0", "1"))
SHARES = (0.94, 0.02, 0.035, 0.005)
HEADROOM = 1.1


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = mixing.train(docs, table(spark, sf_dir, "labels"), ("quality", "toxic"), DOMAINS)
    return mixing.mix(docs, model, SHARES, headroom=HEADROOM)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.default_models(docs))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in secret_scan.KINDS],
        F.sha2(secret_scan.joined("assign", "access", "hex"), 256).alias("base_sha256"),
        secret_scan.joined(*secret_scan.KINDS).alias("spans"))


def op9_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    ensemble = rule_ensemble.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = rule_ensemble.score(docs, ensemble)
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"), n=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_repair.repair(conversation_repair.damaged(turns))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_sharding": op2_sharding,
    "op3_license_scan": op3_license_scan,
    "op4_pii_crf": op4_pii_crf,
    "op5_ngram_join": op5_ngram_join,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_mixing": op7_mixing,
    "op8_secret_scan": op8_secret_scan,
    "op9_rule_ensemble": op9_rule_ensemble,
    "op10_decontaminate": op10_decontaminate,
    "op11_html_extraction": op11_html_extraction,
    "op12_source_audit": op12_source_audit,
    "op13_conversation_repair": op13_conversation_repair,
}
