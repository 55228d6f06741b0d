"""One query opN_ for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, line_templates, oracles, quality_rules, warc
from .chat_tree import chat_tree, read_back
from .decontaminate import contamination
from .ngram_join import similarity_classes
from .sampled_pieces import encode_sampled
from .suffix_dedup import remove_repeats
from .token_files import document_tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", language_id.held_out().alias("held_out"))
    found = language_id.identify(rows, language_id.learn(docs), carry=("doc_id", "held_out"), spans=False)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled ids of each text, and whether decoding gives the text back."""
    rows = encode_sampled(table(spark, sf_dir, "documents"), decoded=True)
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == text).alias("lossless"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), texts=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5 that need no rules."""
    return op5_quality_rules(spark, sf_dir).drop("kept")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(path, index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], rows.schema))
    return read_back(*chat_tree(rows))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document, counted in flat files."""
    return document_tokens(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_templates(docs).select("doc_id", "n_lines", "n_dropped", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_quality_rules": op5_quality_rules,
    "quality_base": quality_base,
    "op6_warc": op6_warc,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_token_counts": op9_token_counts,
    "op10_line_dedup": op10_line_dedup,
}
ORACLES: dict[str, str] = {
    "op4_decontamination": oracles.OP4,
    "quality_base": oracles.QUALITY_BASE,
    "op6_warc": oracles.OP6,
    "op7_chat_formatting": oracles.OP7,
    "op8_ngram_jaccard_join": oracles.OP8,
    "op10_line_dedup": line_templates.oracle(),
}
