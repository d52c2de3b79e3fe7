"""The queries of this subpackage and their SQL, for the registry."""

from __future__ import annotations

from . import (
    byte_bpe, decontamination, embedding_dedup, filter_audit, language, licenses, mixing, secrets, simhash, token_counts, token_shards, toxicity, vector_codes,
)

QUERIES = {
    "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
    "op2_licenses": licenses.op2_licenses,
    "op3_secrets": secrets.op3_secrets,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_language": language.op5_language,
    "op6_simhash": simhash.op6_simhash,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_mixing": mixing.op8_mixing,
    "op9_token_shards": token_shards.op9_token_shards,
    "op10_decontamination": decontamination.op10_decontamination,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_byte_bpe": byte_bpe.op12_byte_bpe,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

ORACLES: dict[str, str] = {
    "op2_licenses": licenses.OP2_SQL,
    "op3_secrets": secrets.OP3_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op13_vector_codes": vector_codes.OP13_SQL,
}
