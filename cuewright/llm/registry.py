"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, divergence, html_text, language_id, ngram_join, packing, pieces, quality_classifier, quality_rules, search, secrets, warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_benchmark_decontamination": decontaminate.op1_benchmark_decontamination,
        "op2_ngram_jaccard_join": ngram_join.op2_ngram_jaccard_join,
        "op3_html_extraction": html_text.op3_html_extraction,
        "op4_language_id": language_id.op4_language_id,
        "op5_secret_scans": secrets.op5_secret_scans,
        "op6_warc": warc.op6_warc,
        "op7_chat_formatting": chat.op7_chat_formatting,
        "op8_best_fit_packing": packing.op8_best_fit_packing,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_quality_classifier": quality_classifier.op10_quality_classifier,
        "op11_sentencepiece": pieces.op11_sentencepiece,
        "op12_lexical_search": search.op12_lexical_search,
        "op13_source_divergence": divergence.op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_benchmark_decontamination": decontaminate.ORACLE,
        "op2_ngram_jaccard_join": ngram_join.ORACLE,
        "op5_secret_scans": secrets.ORACLE,
        "op6_warc": warc.ORACLE,
        "op7_chat_formatting": chat.ORACLE,
        "op9_quality_rules": quality_rules.ORACLE,
        "op12_lexical_search": search.ORACLE,
        "op13_source_divergence": divergence.ORACLE,
    }
