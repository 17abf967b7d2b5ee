"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from riskloom.llm import fuzzyhash, jaccard, lexsearch, linededup, media, mixing, packing, pii, quality, runs, suffixdedup, topk, toxicity


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality,
        "op2_pii": pii.op2_pii,
        "op3_ngram_jaccard": jaccard.op3_ngram_jaccard,
        "op4_packing": packing.op4_packing,
        "op5_suffix_dedup": suffixdedup.op5_suffix_dedup,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_media": media.op7_media,
        "op8_source_mixing": mixing.op8_source_mixing,
        "op9_exact_topk": topk.op9_exact_topk,
        "op10_line_dedup": linededup.op10_line_dedup,
        "op11_periodic_runs": runs.op11_periodic_runs,
        "op12_fuzzy_fingerprint": fuzzyhash.op12_fuzzy_fingerprint,
        "op13_lexical_search": lexsearch.op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_jaccard": jaccard.OP3_SQL, "op9_exact_topk": topk.OP9_SQL, "op10_line_dedup": linededup.OP10_SQL, "op13_lexical_search": lexsearch.OP13_SQL}
