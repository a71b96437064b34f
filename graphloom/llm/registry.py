"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from graphloom.llm import bpe, chat, classifier, lines, mixture, neighbours, ngrams, rules, shards, suffixes

QUERIES = {
    "op1_shards": shards.op1_shards,
    "op2_chat": chat.op2_chat,
    "op3_mixture": mixture.op3_mixture,
    "op4_suffixes": suffixes.op4_suffixes,
    "op5_neighbours": neighbours.op5_neighbours,
    "op6_bpe": bpe.op6_bpe,
    "op7_quality": classifier.op7_quality,
    "op8_ngrams": ngrams.op8_ngrams,
    "op9_lines": lines.op9_lines,
    "op10_rules": rules.op10_rules,
}

ORACLES = {"op3_mixture": mixture.OP3_SQL, "op10_rules": rules.OP10_SQL}
