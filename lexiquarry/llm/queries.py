"""The queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from lexiquarry.llm import chat_tree, fingerprints, importance, language_id, line_dedup, mixing, ngram_join, periodic_runs, quality_rules, sentencepiece_fst, sharding, toxicity, warc_fixity

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_mixing": mixing.op3_mixing,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_sentencepiece": sentencepiece_fst.op5_sentencepiece,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_language_id": language_id.op9_language_id,
    "op10_warc_fixity": warc_fixity.op10_warc_fixity,
    "op11_chat_tree": chat_tree.op11_chat_tree,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_importance": importance.op13_importance,
}

SQL = {
    "op2_quality_rules": quality_rules.OP2_SQL,
    "op8_line_dedup": line_dedup.OP8_SQL,
    "op11_chat_tree": chat_tree.OP11_SQL,
    "op13_importance": importance.OP13_SQL,
}
