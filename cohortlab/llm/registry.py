"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import chat, decontaminate, fim, html_text, jaccard, merkle, mixing, odd_sketch, pii, quality, scoring, suffixes, urls

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_html": html_text.op2_html,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_mixing": mixing.op5_mixing,
    "op6_ppm": scoring.op6_ppm,
    "op7_suffixes": suffixes.op7_suffixes,
    "op8_urls": urls.op8_urls,
    "op9_pii": pii.op9_pii,
    "op10_chat": chat.op10_chat,
    "op11_fim": fim.op11_fim,
    "op12_odd_sketch": odd_sketch.op12_odd_sketch,
    "op13_merkle": merkle.op13_merkle,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_quality": quality.OP1_SQL,
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op8_urls": urls.OP8_SQL,
    "op10_chat": chat.OP10_SQL,
    "op11_fim": fim.OP11_SQL,
    "op13_merkle": merkle.OP13_SQL,
}
