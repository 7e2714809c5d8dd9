"""All registered queries of the scan engine, and the SQL that checks them."""

from __future__ import annotations

from lociq.plans import flow_queries, haplotype_queries, interval_queries, model_queries, source_queries, spectrum_queries, table_queries

MODULES = (spectrum_queries, haplotype_queries, interval_queries, flow_queries, model_queries, table_queries, source_queries)


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= m.ORACLES
    return out
