"""All queries of the core with their reference SQL."""

from __future__ import annotations

from sediment.plans import belief_queries, data_quality, recall_queries, report_queries, retrieval_queries, text_queries, workspace_queries

MODULES = [data_quality, text_queries, belief_queries, retrieval_queries, report_queries, recall_queries, workspace_queries]


def queries():
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql():
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}


def flagship(spark, directory):
    return queries()["recall_topk"](spark, directory)
