"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from trajgraph.llm import decontaminate, fingerprints, hard_negatives, langid, mixing, near_dedup, oracles, pii, quality, resampling, sharding, suffix_dedup, topk_search, toxicity

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_mixing": mixing.op4_mixing,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_sharding": sharding.op6_sharding,
    "op7_langid": langid.op7_langid,
    "op8_pii": pii.op8_pii,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_topk_search": topk_search.op12_topk_search,
    "op13_resampling": resampling.op13_resampling,
}

ORACLES = {"op4_mixing": oracles.OP4, "op9_near_dedup": oracles.OP9, "op10_decontamination": oracles.OP10, "op11_hard_negatives": oracles.OP11, "op12_topk_search": oracles.OP12, "op13_resampling": oracles.OP13}
