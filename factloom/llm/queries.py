"""The queries of this subpackage, with the SQL that checks those that SQL can express."""

from __future__ import annotations

from . import asof, decontaminate, jaccard, lexical, licenses, linededup, packing, passages, pieces, pii, quality, tokenbin, toxicity


def queries() -> dict:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_pieces": pieces.op2_pieces,
        "op6_licenses": licenses.op6_licenses,
        "op3_token_binary": tokenbin.op3_token_binary,
        "op4_jaccard_join": jaccard.op4_jaccard_join,
        "op5_quality": quality.op5_quality,
        "op7_passages": passages.op7_passages,
        "op8_toxicity": toxicity.op8_toxicity,
        "op10_pii": pii.op10_pii,
        "op9_line_dedup": linededup.op9_line_dedup,
        "op11_asof": asof.op11_asof,
        "op12_lexical": lexical.op12_lexical,
        "op13_packing": packing.op13_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_jaccard_join": jaccard.OP4_SQL, "op5_quality": quality.OP5_SQL, "op9_line_dedup": linededup.OP9_SQL, "op11_asof": asof.OP11_SQL, "op12_lexical": lexical.OP12_SQL}
