"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import collocations, decontaminate, hard_negatives, html_text, licenses, mixing, ngram_join, packing, pii, pitman_yor, revisits, topk, toxicity

QUERIES = {
    "op1_exact_top_k": topk.op1_exact_top_k,
    "op2_pack_documents": packing.op2_pack_documents,
    "op3_pii_spans": pii.op3_pii_spans,
    "op4_pitman_yor": pitman_yor.op4_pitman_yor,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_revisits": revisits.op8_revisits,
    "op9_main_text": html_text.op9_main_text,
    "op10_ngram_join": ngram_join.op10_ngram_join,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_mixed_sources": mixing.op12_mixed_sources,
    "op13_collocations": collocations.op13_collocations,
}
ORACLE = {"op1_exact_top_k": topk.SQL, "op7_license_scan": licenses.SQL, "op8_revisits": revisits.SQL, "op11_hard_negatives": hard_negatives.SQL, "op13_collocations": collocations.SQL}
