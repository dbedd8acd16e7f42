"""Queries and oracles of this subpackage, as the entry module registers them."""

from __future__ import annotations

from . import classifier, ctw, decontaminate, jaccard, packing, secrets, substring, topk, urls, warc

QUERIES = {
    "op1_url_filter": urls.op1_url_filter,
    "op2_ctw_scores": ctw.op2_ctw_scores,
    "op3_ngram_jaccard": jaccard.op3_ngram_jaccard,
    "op3_link_counts": jaccard.op3_link_counts,
    "op4_warc": warc.op4_warc,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_exact_topk": topk.op7_exact_topk,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_substring_dedup": substring.op9_substring_dedup,
    "op10_quality": classifier.op10_quality,
}

#: op2, op5, op8 and op10 can't be said in SQL; their tests hold them against brute force, round trips and held-out labels.
ORACLES = {
    "op1_url_filter": urls.ORACLE,
    "op3_ngram_jaccard": jaccard.ORACLE,
    "op3_link_counts": jaccard.LINK_ORACLE,
    "op4_warc": warc.ORACLE,
    "op6_secret_scan": secrets.ORACLE,
    "op7_exact_topk": topk.ORACLE,
    "op9_substring_dedup": substring.ORACLE,
}
