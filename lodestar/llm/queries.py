"""The thin queries over whole tables, one for each operator of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontam import contaminated
from .html_text import extract_text
from .language import identify
from .packing import pack
from .pitman_yor import score_texts
from .quality import judge
from .sharding import shard
from .simhash import near_duplicates
from .storage import crc_remainder, table
from .token_counts import count_tokens
from .toxicity import fit_toxicity, score_toxicity

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = "word_bpe_49k.json"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, by non-negative PU learning from the training side; edge cases: ``toxicity``."""
    docs = table(spark, sf_dir, "documents")
    train = crc_remainder("doc_id") != 0
    model = fit_toxicity(docs.filter(train), table(spark, sf_dir, "labels").filter(train))
    return score_toxicity(docs, model).select("doc_id", (crc_remainder("doc_id") == 0).alias("held_out"), "score", "predicted")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of at most 4096; edge cases: ``packing``."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; edge cases: ``html_text``."""
    return extract_text(table(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; edge cases: ``simhash``."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the forest's verdict for every document; edge cases: ``quality``."""
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly", "threshold")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from the training side; edge cases: ``language``."""
    docs = table(spark, sf_dir, "documents")
    training = docs.filter(crc_remainder("doc_id") != 0)
    return identify(docs, training).select("doc_id", (crc_remainder("doc_id") == 0).alias("held_out"), "lang_pred", "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the alignment's score; edge cases: ``decontam``."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every whole text, learned from the training side; edge cases: ``pitman_yor``."""
    held_out = crc_remainder("doc_id") == 1
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    return score_texts(docs, docs.filter(~F.col("held_out")), carried=("held_out",))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law ``rows``; edge cases: ``sharding``."""
    return shard(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text; edge cases: ``token_counts``."""
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def queries() -> dict[str, Query]:
    return {"op1_toxicity": op1_toxicity, "op2_packing": op2_packing, "op3_html_text": op3_html_text, "op4_simhash": op4_simhash, "op5_quality": op5_quality, "op6_language": op6_language, "op7_decontamination": op7_decontamination, "op8_language_model": op8_language_model, "op9_sharding": op9_sharding, "op10_token_counts": op10_token_counts}


def oracle_sql() -> dict[str, str]:
    return {}
