"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Query name and the module that holds query() and, where SQL can express it, SQL.
MODULES = {
    "op1_exact_dedup": "exact_dedup",
    "op2_kd_shards": "kd_shards",
    "op3_line_dedup": "line_dedup",
    "op4_quality_classifier": "quality",
    "op5_warc": "warc",
    "op6_license_scan": "license_scan",
    "op7_ngram_jaccard_join": "jaccard_join",
    "op8_packing": "packing",
    "op9_benchmark_decontamination": "decontamination",
    "op10_pii": "pii",
    "op11_merkle_manifest": "merkle",
    "op12_vector_codes": "vector_codes",
    "op13_sentencepiece": "piece_bpe",
}


def _module(name: str):
    return import_module(f"{__package__}.{name}")


def load() -> None:
    """Imports all modules of the queries, so that what is missing shows at once."""
    for name in MODULES.values():
        _module(name)


def queries() -> dict:
    return {key: _module(name).query for key, name in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {key: sql for key, name in MODULES.items() if (sql := getattr(_module(name), "SQL", None))}
