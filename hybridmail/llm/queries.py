"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from hybridmail.llm import ann, decontaminate, embeddups, importance, mixing, neardups, ngrams, phrases, pii, quality, substrings, tokens, warc

QUERIES = {
    "op1_pii": pii.op1,
    "op2_ann": ann.op2,
    "op3_mixing": mixing.op3,
    "op4_tokens": tokens.op4,
    "op5_substrings": substrings.op5,
    "op6_neardups": neardups.op6,
    "op7_quality": quality.op7,
    "op8_decontaminate": decontaminate.op8,
    "op9_warc": warc.op9,
    "op10_ngrams": ngrams.op10,
    "op11_importance": importance.op11,
    "op12_phrases": phrases.op12,
    "op13_embeddups": embeddups.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op5_substrings": substrings.SQL,
    "op6_neardups": neardups.SQL,
    "op8_decontaminate": decontaminate.SQL,
    "op9_warc": warc.SQL,
    "op11_importance": importance.SQL,
    "op12_phrases": phrases.SQL,
    "op13_embeddups": embeddups.SQL,
}
