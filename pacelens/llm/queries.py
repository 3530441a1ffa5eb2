"""Registered queries of the training-data operators, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pacelens.llm import bm25, bpe, conversations, decontaminate, htmltext, interpolation, langid, licenses, mix, near_dup, quality, toxicity, whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": mix.run,
    "op2_bpe_tokens": bpe.run,
    "op3_toxicity": toxicity.run,
    "op4_license_scan": licenses.run,
    "op5_lm_score": interpolation.run,
    "op6_quality_rules": quality.run,
    "op7_language_id": langid.run,
    "op8_bm25_search": bm25.run,
    "op9_main_text": htmltext.run,
    "op10_near_duplicates": near_dup.run,
    "op11_whitening": whiten.run,
    "op12_decontamination": decontaminate.run,
    "op13_conversation_repair": conversations.run,
}

SQL: dict[str, str] = {
    "op1_mix_sources": mix.SQL,
    "op8_bm25_search": bm25.SQL,
    "op12_decontamination": decontaminate.SQL,
}
