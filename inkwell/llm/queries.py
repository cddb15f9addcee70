"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from inkwell.llm import bpe, decontaminate, dialogues, digests, exactsub, lm, middle, neardup, passages, quality, secrets, shards, toxicity

QUERIES = {
    "op1_secret_scans": secrets.op1_secret_scans,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_suffix_dedup": exactsub.op3_suffix_dedup,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_sharding": shards.op5_sharding,
    "op6_near_duplicates": neardup.op6_near_duplicates,
    "op7_lm_scores": lm.op7_lm_scores,
    "op8_repeated_passages": passages.op8_repeated_passages,
    "op9_bpe": bpe.op9_bpe,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_conversation_repair": dialogues.op11_conversation_repair,
    "op12_fill_in_middle": middle.op12_fill_in_middle,
    "op13_fingerprints": digests.op13_fingerprints,
}
ORACLES = {
    "op1_secret_scans": secrets.ORACLE,
    "op2_decontamination": decontaminate.ORACLE,
    "op5_sharding": shards.ORACLE,
    "op12_fill_in_middle": middle.ORACLE,
}
