"""The queries op1 to op10 over whole tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.llm import chat, fingerprint, mixing, oracles, packing, quality, simhash, substring, suffix, toxicity, warc
from runweave.llm.common import new_path, prepare, table


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 4-word shingles and the components of links of at most 4 bits."""
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"), width=4, tau=4)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learnt from labels outside the held-out fifth."""
    labels = _read(spark, sf_dir, "labels")
    found = toxicity.score(_read(spark, sf_dir, "documents").select("doc_id", "text"), toxicity.learnable(labels))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return found.select(
        "doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"),
        F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bin and offset of every piece of every document."""
    return packing.pack(_read(spark, sf_dir, "documents"))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages with revisit records, written, read back and resolved."""
    path = new_path(spark, "warc")
    warc.write_archives(_read(spark, sf_dir, "pages"), path)
    found = table(warc.read_archives(spark, path), "warc-records")
    return warc.resolve(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every text and its edited text, and how near those and the next document are."""
    return fingerprint.edited_and_next(_read(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-document counts and the verdict of cross-document line frequency."""
    return quality.judge(_read(spark, sf_dir, "documents")).drop("source", "text_hash")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without bytes covered by 100-byte strings that start earlier."""
    found = suffix.dedup_bytes(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1 as prefix trees, written and read back."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    path = new_path(spark, "chat")
    chat.write_trees(rows, path)
    found = chat.read_trees(spark.read.parquet(path))
    return found.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op9_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of all sources takes of every document."""
    found = mixing.mix(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "epochs", "taken")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without words covered by 20-word windows that start earlier."""
    found = substring.dedup_words(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_warc_revisits": op4_warc_revisits,
    "op5_document_fingerprints": op5_document_fingerprints,
    "op6_quality_rules": op6_quality_rules,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_mixing_sources": op9_mixing_sources,
    "op10_substring_dedup": op10_substring_dedup,
}
ORACLES: dict[str, str] = {
    "op4_warc_revisits": oracles.WARC,
    "op5_document_fingerprints": oracles.FINGERPRINTS,
    "op6_quality_rules": oracles.QUALITY,
    "op7_suffix_array_dedup": oracles.BYTES,
    "op8_chat_formatting": oracles.CHAT,
    "op9_mixing_sources": oracles.MIXING,
    "op10_substring_dedup": oracles.SUBSTRING,
}
