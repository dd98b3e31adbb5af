"""Queries of this folder and their SQL, by the names they are registered under."""

from __future__ import annotations

from . import ann, chat, html, linedup, mixing, neardup, negatives, packing, repeats, secrets, topk, toxicity, variants

QUERIES = {
    "op1_chat": chat.op1_chat,
    "op2_topk": topk.op2_topk,
    "op3_packing": packing.op3_packing,
    "op4_secrets": secrets.op4_secrets,
    "op5_near_dedup": neardup.op5_near_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_ann": ann.op7_ann,
    "op8_html": html.op8_html,
    "op9_line_dedup": linedup.op9_line_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_variants": variants.op11_variants,
    "op12_repeats": repeats.op12_repeats,
    "op13_negatives": negatives.op13_negatives,
}

#: The others have no SQL form that runs on whole tables; their tests compare them with brute force.
SQL = {"op1_chat": chat.OP1_SQL, "op2_topk": topk.OP2_SQL, "op4_secrets": secrets.OP4_SQL, "op9_line_dedup": linedup.OP9_SQL, "op11_variants": variants.OP11_SQL, "op13_negatives": negatives.OP13_SQL}
