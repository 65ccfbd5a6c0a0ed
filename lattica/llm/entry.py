"""Queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import chat, decontamination, lexical_search, licenses, lm_score, ngram_join, packing, periodic_runs, quality_model, quality_rules, token_counts, token_files, warc

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_chat_format": chat.op3_chat_format,
    "op4_token_files": token_files.op4_token_files,
    "op5_lm_score": lm_score.op5_lm_score,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_quality_model": quality_model.op8_quality_model,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_packing": packing.op10_packing,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_warc": warc.op13_warc,
}
ORACLE_SQL = {"op2_license_scan": licenses.oracle_sql(), "op3_chat_format": chat.OP3_SQL, "op7_decontamination": decontamination.OP7_SQL, "op9_quality_rules": quality_rules.OP9_SQL, "op12_lexical_search": lexical_search.OP12_SQL, "op13_warc": warc.OP13_SQL}
