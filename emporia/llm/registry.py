"""Queries of this subpackage and the DuckDB SQL of those that have one."""

from __future__ import annotations

from . import bpe, centroids, chat, decontam, langid, lines, ngrams, quality, resample, simhash, tokens, toxicity, urls

QUERIES = {
    "op1_quotation_links": chat.op1_quotation_links,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_template_decontamination": decontam.op3_template_decontamination,
    "op4_language_id": langid.op4_language_id,
    "op5_url_filters": urls.op5_url_filters,
    "op6_bpe": bpe.op6_bpe,
    "op7_fuzzy_line_dedup": lines.op7_fuzzy_line_dedup,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_token_counts": tokens.op9_token_counts,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_importance_resampling": resample.op11_importance_resampling,
    "op12_ngram_jaccard_join": ngrams.op12_ngram_jaccard_join,
    "op13_centroid_clustering": centroids.op13_centroid_clustering,
}

ORACLES = {
    "op1_quotation_links": chat.SQL,
    "op5_url_filters": urls.SQL,
    "op8_quality_rules": quality.SQL,
    "op11_importance_resampling": resample.SQL,
    "op12_ngram_jaccard_join": ngrams.SQL,
    "op13_centroid_clustering": centroids.SQL,
}
