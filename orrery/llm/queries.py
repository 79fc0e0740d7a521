"""The queries of the training-data operators, and SQL for those that SQL can express."""

from .conversations import OP12_SQL, op12_repair_conversations
from .divergence import OP11_SQL, op11_audit_sources
from .exact import OP13_SQL, op13_dedup_exact
from .forest import op10_near_duplicates
from .langid import op2_identify_languages
from .lines import OP1_SQL, op1_dedup_lines
from .mixing import OP6_SQL, op6_mix_sources
from .packing import op9_pack_sequences
from .search import op5_nearest_neighbours
from .simhash import op7_simhash_components
from .substrings import op3_dedup_substrings
from .toxicity import op4_score_toxicity
from .urls import OP8_SQL, op8_filter_urls

QUERIES = {
    q.__name__: q
    for q in (
        op1_dedup_lines,
        op2_identify_languages,
        op3_dedup_substrings,
        op4_score_toxicity,
        op5_nearest_neighbours,
        op6_mix_sources,
        op7_simhash_components,
        op8_filter_urls,
        op9_pack_sequences,
        op10_near_duplicates,
        op11_audit_sources,
        op12_repair_conversations,
        op13_dedup_exact,
    )
}
ORACLE_SQL = {
    "op1_dedup_lines": OP1_SQL,
    "op6_mix_sources": OP6_SQL,
    "op8_filter_urls": OP8_SQL,
    "op11_audit_sources": OP11_SQL,
    "op12_repair_conversations": OP12_SQL,
    "op13_dedup_exact": OP13_SQL,
}
