"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import bpe, chat_format, decontaminate, jaccard_join, language_id, quality_qda, quality_rules, sharding, substring_dedup, token_file

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_sharding": sharding.op2_sharding,
    "op3_language": language_id.op3_language,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_token_file": token_file.op5_token_file,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_chat_format": chat_format.op7_chat_format,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_quality": quality_qda.op9_quality,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}
ORACLE = {
    "op6_decontaminate": decontaminate.ORACLE,
    "op8_jaccard_join": jaccard_join.ORACLE,
    "op7_chat_format": chat_format.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
}
