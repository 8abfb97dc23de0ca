"""Queries of the training-text operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from readlens.llm import chat, decontaminate, divergence, fingerprints, html, jaccard_join, langid, linededup, minhash, mixing, prefixtrie, quality, tokens
from readlens.llm.common import read


def token_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": lambda s, d: fingerprints.fingerprints(read(s, d, "documents")),
        "op2_jaccard_join": lambda s, d: jaccard_join.components(read(s, d, "documents")),
        "op3_decontaminate": lambda s, d: decontaminate.report(read(s, d, "documents"), read(s, d, "benchmark")),
        "op4_chat_format": lambda s, d: chat.format_conversations(read(s, d, "conversations")),
        "op5_mix_sources": lambda s, d: mixing.mix_sources(read(s, d, "documents")),
        "op6_quality": lambda s, d: quality.classify(read(s, d, "documents"), read(s, d, "labels"), entry=1),
        "op7_language_id": lambda s, d: langid.predictions(read(s, d, "documents")),
        "op8_line_dedup": lambda s, d: linededup.dedup_lines(read(s, d, "documents")),
        "op9_token_ids": lambda s, d: tokens.token_id_output(read(s, d, "documents"), token_path()),
        "op10_html_extract": lambda s, d: html.extract(read(s, d, "pages")),
        "op11_prefix_trie": lambda s, d: prefixtrie.prefix_trie(read(s, d, "conversations")),
        "op12_minhash_dedup": lambda s, d: minhash.near_duplicates(read(s, d, "documents")),
        "op13_source_divergence": lambda s, d: divergence.divergence(read(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_jaccard_join": jaccard_join.ORACLE_SQL,
        "op3_decontaminate": decontaminate.ORACLE_SQL,
        "op11_prefix_trie": prefixtrie.ORACLE_SQL,
        "op12_minhash_dedup": minhash.ORACLE_SQL,
        "op13_source_divergence": divergence.ORACLE_SQL,
    }
