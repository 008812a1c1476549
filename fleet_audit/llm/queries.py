"""One registered query per operator, each over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from fleet_audit.llm.op1_projected_search import op1_projected_kdtree_search
from fleet_audit.llm.op2_warc import op2_arc_to_warc, op2_sql
from fleet_audit.llm.op3_sharding import op3_balanced_label_propagation
from fleet_audit.llm.op4_disclosure import op4_pii_disclosure
from fleet_audit.llm.op5_decontaminate import op5_benchmark_decontamination
from fleet_audit.llm.op6_bpe import op6_byte_level_bpe
from fleet_audit.llm.op7_quality import op7_compression_quality
from fleet_audit.llm.op8_simhash import op8_simhash_near_dedup
from fleet_audit.llm.op9_line_dedup import op9_content_defined_line_dedup
from fleet_audit.llm.op10_url_filter import op10_redirect_url_filter, op10_sql
from fleet_audit.llm.op11_importance import op11_importance_resampling, op11_sql
from fleet_audit.llm.op12_prefix_trie import op12_prefix_trie, op12_sql
from fleet_audit.llm.op13_html_extraction import op13_html_extraction

QUERIES = {
    "op1_projected_kdtree_search": op1_projected_kdtree_search,
    "op2_arc_to_warc": op2_arc_to_warc,
    "op3_balanced_label_propagation": op3_balanced_label_propagation,
    "op4_pii_disclosure": op4_pii_disclosure,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_byte_level_bpe": op6_byte_level_bpe,
    "op7_compression_quality": op7_compression_quality,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_content_defined_line_dedup": op9_content_defined_line_dedup,
    "op10_redirect_url_filter": op10_redirect_url_filter,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_html_extraction": op13_html_extraction,
}
ORACLES = {
    "op2_arc_to_warc": op2_sql, "op10_redirect_url_filter": op10_sql, "op11_importance_resampling": op11_sql, "op12_prefix_trie": op12_sql,
}
