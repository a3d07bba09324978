"""The queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

#: Query name -> module that holds the function of that name.
MODULES = {
    "op1_line_dedup": "line_dedup",
    "op2_simhash": "simhash",
    "op3_personal_data": "pii",
    "op4_token_store": "token_store",
    "op5_toxicity": "toxicity",
    "op6_order_minhash": "order_minhash",
    "op7_source_mixing": "mixing",
    "op8_language_id": "language_id",
    "op9_packing": "packing",
    "op10_quality_rules": "quality_rules",
    "op11_filter_audit": "filter_audit",
    "op12_vector_codes": "vector_codes",
    "op13_sharding": "sharding",
}

#: Queries whose rows SQL can express, by the module that holds it.
ORACLES = {name: MODULES[name] for name in ("op1_line_dedup", "op11_filter_audit", "op12_vector_codes", "op13_sharding")}


def _module(name: str):
    return importlib.import_module(f"{__package__}.{name}")


def queries() -> dict:
    return {name: getattr(_module(module), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: _module(module).ORACLE for name, module in ORACLES.items()}
