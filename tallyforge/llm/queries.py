"""Queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from . import conversation_trie, exact_dedup, filter_audit, html_extract, jaccard_join, langid, media_jpeg, mixing, packing, quality_gam, sql, substring_dedup, topk, url_filter
from .common import table

QUERIES = {
    "op1_media_jpeg": lambda spark, d: media_jpeg.media_report(table(spark, d, "documents")),
    "op2_quality_gam": lambda spark, d: quality_gam.quality_report(table(spark, d, "documents"), table(spark, d, "labels")),
    "op3_mixing": lambda spark, d: mixing.mixing_report(table(spark, d, "documents")),
    "op4_substring_dedup": lambda spark, d: substring_dedup.dedup_report(table(spark, d, "documents")),
    "op5_jaccard_join": lambda spark, d: jaccard_join.join_report(table(spark, d, "documents")),
    "op6_packing": lambda spark, d: packing.packing_report(table(spark, d, "documents")),
    "op7_url_filter": lambda spark, d: url_filter.url_report(table(spark, d, "pages")),
    "op8_topk": lambda spark, d: topk.search_report(table(spark, d, "embeddings")),
    "op9_html_extract": lambda spark, d: html_extract.extraction_report(table(spark, d, "pages")),
    "op10_langid": lambda spark, d: langid.language_report(table(spark, d, "documents")),
    "op11_filter_audit": lambda spark, d: filter_audit.audit_report(table(spark, d, "documents"), table(spark, d, "labels")),
    "op12_exact_dedup": lambda spark, d: exact_dedup.dedup_report(table(spark, d, "documents")),
    "op13_conversation_trie": lambda spark, d: conversation_trie.trie_report(table(spark, d, "conversations")),
}

ORACLES = sql.ORACLES
