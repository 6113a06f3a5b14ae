"""Queries of the llm operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
from rubrica.llm import alignment, decontaminate, langid, lexical, mainpage, maxent, mixing, mpeg, neardup, quality, sharding, substrings, topk

QUERIES = {
    "op1_lm_score": maxent.op1_lm_score,
    "op2_media": mpeg.op2_media,
    "op3_quality": quality.op3_quality,
    "op4_language_id": langid.op4_language_id,
    "op5_substring_dedup": substrings.op5_substring_dedup,
    "op6_html": mainpage.op6_html,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_sharding": sharding.op8_sharding,
    "op9_mixing": mixing.op9_mixing,
    "op10_near_duplicates": neardup.op10_near_duplicates,
    "op11_topk": topk.op11_topk,
    "op12_alignment": alignment.op12_alignment,
    "op13_lexical": lexical.op13_lexical,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {"op7_decontamination": decontaminate.ORACLE, "op9_mixing": mixing.ORACLE, "op11_topk": topk.ORACLE, "op13_lexical": lexical.ORACLE}
