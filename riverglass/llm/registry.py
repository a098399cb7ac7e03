"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, decontamination, licenses, line_dedup, media_store, ngram_join, pseudo_likelihood, token_counts, toxicity, url_filter

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_media_columns": media_store.op4_media_columns,
    "op5_lm_scores": pseudo_likelihood.op5_lm_scores,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_bpe_round_trip": bpe.op9_bpe_round_trip,
    "op10_license_scan": licenses.op10_license_scan,
}
ORACLE = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op3_decontamination": decontamination.OP3_SQL,
    "op7_url_filter": url_filter.OP7_SQL,
    "op8_ngram_join": ngram_join.OP8_SQL,
}
