"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from . import conversation_trie, exact_dedup, filter_audit, jaccard_join, substring_dedup, topk, url_filter

ORACLES = {
    "op4_substring_dedup": substring_dedup.oracle(),
    "op5_jaccard_join": jaccard_join.oracle(),
    "op7_url_filter": url_filter.oracle(),
    "op8_topk": topk.oracle(),
    "op11_filter_audit": filter_audit.oracle(),
    "op12_exact_dedup": exact_dedup.oracle(),
    "op13_conversation_trie": conversation_trie.oracle(),
}
