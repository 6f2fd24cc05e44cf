"""All queries of the subpackage with their reference SQL."""

from __future__ import annotations

from sediment.llm import queries_text, queries_vectors

MODULES = [queries_text, queries_vectors]


def queries():
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql():
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
