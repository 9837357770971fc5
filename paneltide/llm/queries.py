"""Queries of this subpackage by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import align, bpe, codes, decontaminate, dedup_exact, language, lines, lm, neardup, quality, sharding, substrings, warc

QUERIES = {
    "op1_language": language.op1_language,
    "op2_exact_dedup": dedup_exact.op2_exact_dedup,
    "op3_near_duplicates": neardup.op3_near_duplicates,
    "op4_substrings": substrings.op4_substrings,
    "op5_bpe": bpe.op5_bpe,
    "op6_lines": lines.op6_lines,
    "op7_warc": warc.op7_warc,
    "op8_quality": quality.op8_quality,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_sharding": sharding.op10_sharding,
    "op11_alignment": align.op11_alignment,
    "op12_codes": codes.op12_codes,
    "op13_lm": lm.op13_lm,
}
ORACLES = {"op2_exact_dedup": dedup_exact.ORACLE, "op7_warc": warc.ORACLE, "op12_codes": codes.ORACLE}
