"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

import corpus_pipeline

MODULES = (
    "q_packing",
    "q_toxicity",
    "q_fixity",
    "q_license_scan",
    "q_exact_dedup",
    "q_lm_scoring",
    "q_mixing",
    "q_html_extraction",
    "q_ngram_join",
    "q_cap_join",
)


def _gather(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"{__package__}.{module}"), name)
    return out


def queries() -> dict:
    return _gather("QUERIES") | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    own = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return _gather("ORACLE_SQL") | own
