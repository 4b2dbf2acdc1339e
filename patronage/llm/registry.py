"""The queries of this subpackage (``QUERIES``) and their DuckDB SQL (``ORACLES``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (
    chat, fill_middle, fingerprint, html_text, line_dedup, near_dup, packing, pieces, quality_model, quality_rules,
    simhash, spelling, suffix_dedup,
)
from .common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_prob_minhash(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_fingerprint(spark, sf_dir):
    return fingerprint.edit_digest(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark, sf_dir):
    return pieces.encode_digest(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_chat_format(spark, sf_dir):
    """All conversations (one row a turn) and conversation -7 (a messages record)."""
    text = "\\### Assistant: </turn> ok"
    message = [F.struct(F.lit(r).alias("role"), F.lit(text).alias("content")) for r in ("user", "assistant")]
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.array(*message).alias("messages"))
    turns = chat.to_turns(table(spark, sf_dir, "conversations")).unionByName(chat.to_turns(extra))
    return chat.chat_digest(chat.format_chat(turns))


def op5_suffix_dedup(spark, sf_dir):
    return suffix_dedup.substring_digest(table(spark, sf_dir, "documents"))


def op6_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_quality_rules(spark, sf_dir):
    return quality_rules.rules_digest(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark, sf_dir):
    return line_dedup.line_dedup_digest(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark, sf_dir):
    return quality_model.quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_fill_in_middle(spark, sf_dir):
    return fill_middle.fill_digest(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark, sf_dir):
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op13_simhash(spark, sf_dir):
    return simhash.simhash_classes(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_prob_minhash": op1_prob_minhash,
    "op2_fingerprint": op2_fingerprint,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_chat_format": op4_chat_format,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_html_text": op6_html_text,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_simhash": op13_simhash,
}

ORACLES = {
    "op4_chat_format": chat.ORACLE_SQL,
    "op8_quality_rules": quality_rules.ORACLE_SQL,
    "op9_line_dedup": line_dedup.ORACLE_SQL,
    "op11_fill_in_middle": fill_middle.ORACLE_SQL,
    "op12_spelling_variants": spelling.ORACLE_SQL,
}
