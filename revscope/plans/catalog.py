"""All registered queries outside the training-data operators."""

from __future__ import annotations

from revscope.plans import card_queries, event_queries, image_queries, long_queries, packet_queries, report_queries, rule_queries, session_queries, source_queries

MODULES = [report_queries, event_queries, rule_queries, image_queries, source_queries, session_queries, long_queries, packet_queries, card_queries]


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
