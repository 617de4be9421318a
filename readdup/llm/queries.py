"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, fingerprints, html, jaccard, media, mixing, oracles, quality, repeats, token_files


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": mixing.op1_mix_sources,
        "op2_ngram_jaccard": jaccard.op2_ngram_jaccard,
        "op3_fingerprints": fingerprints.op3_fingerprints,
        "op4_quality": quality.op4_quality,
        "op5_chat_format": chat.op5_chat_format,
        "op6_bpe_codec": bpe.op6_bpe_codec,
        "op7_html_text": html.op7_html_text,
        "op8_media_columns": media.op8_media_columns,
        "op9_token_files": token_files.op9_token_files,
        "op10_suffix_dedup": repeats.op10_suffix_dedup,
        "near_fingerprints": fingerprints.near_fingerprints,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
