"""The queries of this subpackage: each applies its operator to its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers

from . import decontaminate, interactions, language, lines, mainhtml, mixing, negatives, quality, quotes, sharding, simhash, tokens, warc
from .common import table


def op1_line_dedup(spark, sf_dir):
    return lines.report(table(spark, sf_dir, "documents"))


def op2_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_mixing(spark, sf_dir):
    return mixing.report(table(spark, sf_dir, "documents"))


def op4_quality(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"))


def op5_token_counts(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_quotes(spark, sf_dir):
    return quotes.reply_ordered(table(spark, sf_dir, "conversations"))


def op7_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_language(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def op9_main_html(spark, sf_dir):
    return mainhtml.extract(table(spark, sf_dir, "pages"))


def op10_decontaminate(spark, sf_dir):
    return decontaminate.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_sharding(spark, sf_dir):
    return sharding.report(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark, sf_dir):
    return negatives.report(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark, sf_dir):
    return interactions.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_warc, op3_mixing, op4_quality, op5_token_counts, op6_quotes, op7_simhash, op8_language, op9_main_html, op10_decontaminate,
        op11_sharding, op12_hard_negatives, op13_filter_audit,
    )
}
ORACLES: dict[str, str] = {"op1_line_dedup": lines.ORACLE, "op2_warc": warc.ORACLE, "op3_mixing": mixing.ORACLE, "op10_decontaminate": decontaminate.ORACLE, "op11_sharding": sharding.ORACLE, "op12_hard_negatives": negatives.ORACLE, "op13_filter_audit": interactions.ORACLE}
