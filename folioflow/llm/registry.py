"""Queries of the training-data operators and their DuckDB equivalents."""

from __future__ import annotations

from folioflow.llm import annsearch, decontam, langid, licenses, linededup, merkle, packing, secrets, simhash, spelling, substring, suffixes, warc

QUERIES = {
    "op1_line_dedup": linededup.op1_line_dedup,
    "op2_packing": packing.op2_packing,
    "op3_secrets": secrets.op3_secrets,
    "op4_substring_dedup": substring.op4_substring_dedup,
    "op5_licenses": licenses.op5_licenses,
    "op6_language_id": langid.op6_language_id,
    "op7_decontamination": decontam.op7_decontamination,
    "op8_warc": warc.op8_warc,
    "op9_mips": annsearch.op9_mips,
    "op10_simhash": simhash.op10_simhash,
    "op11_merkle": merkle.op11_merkle,
    "op12_spelling": spelling.op12_spelling,
    "op13_suffix_dedup": suffixes.op13_suffix_dedup,
}
ORACLES = {
    "op1_line_dedup": linededup.OP1_SQL,
    "op3_secrets": secrets.OP3_SQL,
    "op4_substring_dedup": substring.OP4_SQL,
    "op8_warc": warc.OP8_SQL,
    "op11_merkle": merkle.OP11_SQL,
    "op12_spelling": spelling.OP12_SQL,
    "op13_suffix_dedup": suffixes.OP13_SQL,
}
