"""The queries of this subpackage, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caretide.llm import audio, byte_bpe, decontaminate, filter_audit, html_text, merkle, mixing, pii, sharding, simhash, token_store, toxicity, url_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": decontaminate.query,
    "op2_token_store": token_store.query,
    "op3_byte_bpe": byte_bpe.query,
    "op4_html_text": html_text.query,
    "op5_sharding": sharding.query,
    "op6_pii": pii.query,
    "op7_simhash": simhash.query,
    "op8_url_rules": url_rules.query,
    "op9_toxicity": toxicity.query,
    "op10_audio": audio.query,
    "op11_filter_audit": filter_audit.query,
    "op12_merkle": merkle.query,
    "op13_mixing": mixing.query,
}

ORACLES: dict[str, str] = {
    "op8_url_rules": url_rules.ORACLE_SQL,
    "op11_filter_audit": filter_audit.ORACLE_SQL,
    "op12_merkle": merkle.ORACLE_SQL,
    "op13_mixing": mixing.ORACLE_SQL,
}
