"""The queries of this subpackage, and the SQL that states their results where SQL can."""

from __future__ import annotations

from . import decontaminate, filter_audit, htmltext, jaccard_join, mixing, secrets, spelling, substring_dedup, suffix_dedup, token_files, topk, toxicity, warc

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_topk": topk.op3_topk,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_warc": warc.op5_warc,
    "op6_html_text": htmltext.op6_html_text,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_secrets": secrets.op8_secrets,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_token_files": token_files.op12_token_files,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
SQL = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op2_substring_dedup": substring_dedup.OP2_SQL,
    "op3_topk": topk.OP3_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op5_warc": warc.OP5_SQL,
    "op7_jaccard_join": jaccard_join.OP7_SQL,
    "op9_suffix_dedup": suffix_dedup.OP9_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
