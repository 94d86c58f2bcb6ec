"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from tessera.llm import decontaminate, html_text, licenses, media, mixing, near_dup, quality, repeats, secrets, tokens


def queries() -> dict:
    return {
        "op1_media": media.op1_media,
        "op2_quality": quality.op2_quality,
        "op3_secrets": secrets.op3_secrets,
        "op4_near_duplicates": near_dup.op4_near_duplicates,
        "op5_html": html_text.op5_html,
        "op6_licenses": licenses.op6_licenses,
        "op7_repeats": repeats.op7_repeats,
        "op8_mix": mixing.op8_mix,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "op9_tokens": tokens.op9_tokens,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_near_duplicates": near_dup.OP4_SQL, "op8_mix": mixing.OP8_SQL, "op10_decontaminate": decontaminate.OP10_SQL}
