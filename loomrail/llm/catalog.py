"""The training-data queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomrail.llm import byte_bpe, chat_format, html_text, language_id, mixing, perplexity, prefix_trie, secret_links, simhash, suffix_dedup, topk_search, toxic_spans, yinyang


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_perplexity": perplexity.op1,
        "op2_source_mix": mixing.op2,
        "op3_chat_perspectives": chat_format.op3,
        "op4_toxic_spans": toxic_spans.op4,
        "op5_suffix_dedup": suffix_dedup.op5,
        "op6_byte_bpe": byte_bpe.op6,
        "op7_topk_search": topk_search.op7,
        "op8_html_text": html_text.op8,
        "op9_simhash_near_dedup": simhash.op9,
        "op10_language_id": language_id.op10,
        "op11_yinyang_clusters": yinyang.op11,
        "op12_prefix_trie": prefix_trie.op12,
        "op13_secret_links": secret_links.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mix": mixing.OP2_SQL, "op3_chat_perspectives": chat_format.OP3_SQL, "op7_topk_search": topk_search.OP7_SQL, "op11_yinyang_clusters": yinyang.OP11_SQL, "op12_prefix_trie": prefix_trie.OP12_SQL, "op13_secret_links": secret_links.OP13_SQL}
