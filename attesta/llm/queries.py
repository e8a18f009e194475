"""The operators as named queries over the test tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .alignment import align_tokenizers
from .chat import digests, format_chats, streamed_turns
from .common import table
from .decontaminate import leaks
from .html_extract import main_text
from .line_dedup import drop_repeated_lines
from .lm_score import pseudo_likelihood
from .packing import pack_documents
from .passages import repeated_passages
from .prefix_trie import prefix_trie
from .quality_rules import quality_rules
from .secret_scan import scan_secrets, span_digests
from .simhash import simhash_components
from .sql import ORACLE_SQL
from .toxicity import toxicity

__all__ = ["ORACLE_SQL", "QUERIES"]

# Fixed value: the text of both turns of the added conversation.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-likelihood of every document under a network trained on all of them."""
    return pseudo_likelihood(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in a training window."""
    return pack_documents(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and verdict of every document."""
    return quality_rules(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without repeated chunks of lines, and what it lost."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs, counts=True)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, hash and places of the secrets of every document."""
    return span_digests(scan_secrets(table(spark, sf_dir, "documents")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that documents hold."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain probabilities and verdict of every document."""
    labels = table(spark, sf_dir, "labels").selectExpr("doc_id", "1 - quality AS low_quality", "toxic")
    return toxicity(table(spark, sf_dir, "documents"), labels, ("low_quality", "toxic"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, folded from a log of drafts, edits and deltas, read back from what was rendered."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    return digests(format_chats(streamed_turns(turns.unionByName(added))))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that another document holds as well."""
    return repeated_passages(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash_components(table(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of both tokenizers in every document, scored by corpus-wide pair counts."""
    return align_tokenizers(table(spark, sf_dir, "documents"))


def op12_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages")).drop("n_lines")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations, with their rolled-up totals."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": op1_lm_score,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_quality_rules": op3_quality_rules,
    "op4_line_dedup": op4_line_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_decontamination": op6_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_chat_format": op8_chat_format,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_simhash": op10_simhash,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_html_extract": op12_html_extract,
    "op13_prefix_trie": op13_prefix_trie,
}
