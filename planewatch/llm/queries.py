"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from planewatch.llm import (
    byte_bpe,
    collocations,
    jaccard_join,
    licenses,
    mixing,
    near_dedup,
    quality_model,
    quality_rules,
    spelling,
    substring_dedup,
    tool_calls,
    url_filters,
    vector_search,
)

QUERIES = {
    f.__name__: f
    for f in (
        quality_model.op1_quality_model, url_filters.op2_url_filters, quality_rules.op3_quality_rules, substring_dedup.op4_substring_dedup,
        vector_search.op5_vector_search, byte_bpe.op6_byte_bpe, near_dedup.op7_near_dedup, tool_calls.op8_tool_calls, licenses.op9_licenses,
        mixing.op10_mixing, collocations.op11_collocations, jaccard_join.op12_jaccard_join, spelling.op13_spelling,
    )
}
SQL = {
    "op2_url_filters": url_filters.SQL,
    "op3_quality_rules": quality_rules.SQL,
    "op4_substring_dedup": substring_dedup.SQL,
    # The full sets of all pairs that share a shingle: what the trees must have found.
    "op7_near_dedup": jaccard_join.component_sql(near_dedup.QUERY_WORDS, ", coalesce(m, doc_id) = doc_id AS kept"),
    "op8_tool_calls": tool_calls.SQL,
    "op9_licenses": licenses.SQL,
    "op11_collocations": collocations.SQL,
    "op12_jaccard_join": jaccard_join.SQL,
}
