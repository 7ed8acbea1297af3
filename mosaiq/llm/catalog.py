"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from mosaiq.llm import chat, classifier, collocations, decontaminate, pieces, repair, repeats, rollups, rules, secrets, simhash, tokenfiles, warc

QUERIES = {
    "op1_secret_scan": secrets.query,
    "op2_token_files": tokenfiles.query,
    "op3_quality_rules": rules.query,
    "op3_rule_ablations": rules.query_ablations,
    "op4_quality_classifier": classifier.query,
    "op5_simhash_near_dedup": simhash.query,
    "op6_repeated_passages": repeats.query,
    "op7_warc_archives": warc.query,
    "op8_sentencepiece": pieces.query,
    "op9_token_counts": rollups.query,
    "op9_word_counts": rollups.query_words,
    "op10_benchmark_decontamination": decontaminate.query,
    "op11_conversation_repair": repair.query,
    "op12_phrase_collocations": collocations.query,
    "op13_chat_formatting": chat.query,
}
ORACLES = {
    "op1_secret_scan": secrets.ORACLE,
    "op3_quality_rules": rules.ORACLE,
    "op3_rule_ablations": rules.ORACLE_ABLATIONS,
    "op7_warc_archives": warc.ORACLE,
    "op9_word_counts": rollups.ORACLE_WORDS,
    "op10_benchmark_decontamination": decontaminate.ORACLE,
    "op12_phrase_collocations": collocations.ORACLE,
    "op13_chat_formatting": chat.ORACLE,
}
