"""The thin opN_ queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwell.llm import (
    byte_pairs, decontamination, html_extraction, lexical_search, license_scan, line_dedup, lm_scoring, mixing, quality_classifier, quality_rules, simhash, sql,
    suffix_dedup, whitening,
)
from trackwell.llm.common import bucket_of, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "leak.*")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = found.select("doc_id", "licenses.*").withColumn("base", F.filter("matches", lambda m: m["base"]))
    starts = F.transform("base", lambda m: m["start"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), license_scan.labels(F.col("base")).alias("base_labels"),
        license_scan.labels(F.col("matches")).alias("labels"),
        F.when(F.exists("matches", lambda m: ~m["base"]), 1.0).when(F.size("base") > 0, 0.5).otherwise(0.0).alias("score"),
    )


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = bucket_of(F.col("doc_id"), 5) == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_classifier.score(docs, table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extraction.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    text = F.array_join("blocks", " ")
    return found.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = bucket_of(F.col("doc_id"), 10) == 0
    found = lm_scoring.score(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("doc_id").isNotNull() & ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "rules.*").drop("clean_text")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2(suffix_dedup.kept_bytes(F.col("text"), F.col("spans")), 256).alias("kept_sha256"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select(
        "doc_id", "mix.size", "mix.source_size", "mix.target", mixing.words_taken(F.col("mix")).cast("long").alias("taken"),
        F.array_join(F.transform("mix.draws", lambda d: d["shard"].cast("string")), ",").alias("shards"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.remove_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "dedup.n_lines", "dedup.removed_lines",
        F.length("dedup.clean_text").cast("long").alias("kept_chars"), F.md5(F.col("dedup.clean_text").cast("binary")).alias("kept_md5"),
    )


def op10_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only whole chunks that come up again; op10_line_dedup finds the passages that hold no whole chunk too."""
    found = line_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "dedup.*").select(
        "doc_id", "n_lines", "n_chunks", "removed_chunks", "removed_lines",
        F.length("clean_text").cast("long").alias("kept_chars"), F.md5(F.col("clean_text").cast("binary")).alias("kept_md5"),
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = byte_pairs.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded="decoded")
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_license_scan": op2_license_scan,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_simhash": op4_simhash,
    "op5_html_extraction": op5_html_extraction,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_quality_rules": op7_quality_rules,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_mixing": op9_mixing,
    "op10_line_dedup": op10_line_dedup,
    "op10_chunk_dedup": op10_chunk_dedup,
    "op11_lexical_search": op11_lexical_search,
    "op12_whitening": op12_whitening,
    "op13_byte_pairs": op13_byte_pairs,
}

#: DuckDB SQL by query; a query that SQL can't express is tested against brute force instead.
SQL: dict[str, str] = {"op2_license_scan": sql.OP2, "op7_quality_rules": sql.OP7, "op10_line_dedup": sql.OP10, "op10_chunk_dedup": sql.OP10_CHUNKS, "op11_lexical_search": sql.OP11}
