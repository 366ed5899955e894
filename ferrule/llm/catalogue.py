"""Registered queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from . import decontaminate, extract, jaccard, language, licenses, mix, neardup, negatives, neighbours, pii, secrets, spelling, suffixes


def queries():
    return {
        "op1_near_duplicates": neardup.op1_near_duplicates,
        "op2_main_text": extract.op2_main_text,
        "op3_language": language.op3_language,
        "op4_repeated_passages": suffixes.op4_repeated_passages,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_mix_sources": mix.op6_mix_sources,
        "op7_secrets": secrets.op7_secrets,
        "op8_personal_data": pii.op8_personal_data,
        "op9_licenses": licenses.op9_licenses,
        "op10_neighbours": neighbours.op10_neighbours,
        "op11_jaccard_join": jaccard.op11_jaccard_join,
        "op12_spelling": spelling.op12_spelling,
        "op13_hard_negatives": negatives.op13_hard_negatives,
    }


def oracle_sql():
    return {
        "op1_near_duplicates": neardup.OP1_SQL,
        "op5_decontaminate": decontaminate.OP5_SQL,
        "op6_mix_sources": mix.OP6_SQL,
        "op11_jaccard_join": jaccard.OP11_SQL,
        "op12_spelling": spelling.OP12_SQL,
        "op13_hard_negatives": negatives.OP13_SQL,
    }
