"""All registered queries of the library, by module."""

from __future__ import annotations

from cohortspark.plans import q_audit, q_files, q_heads, q_metrics, q_probs, q_reports, q_resample, q_select

MODULES: list = [q_metrics, q_probs, q_audit, q_select, q_resample, q_reports, q_files, q_heads]


def queries() -> dict:
    return {k: f for m in MODULES for k, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, (_, s) in m.QUERIES.items() if s}


def flagship(spark, sf_dir: str):
    """The source audit: one row per document with its group and whether it is quarantined."""
    return q_audit.QUERIES["source_audit"][0](spark, sf_dir)
