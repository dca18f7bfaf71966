"""All queries outside the optional subpackage."""

from __future__ import annotations

from ticketloom.plans import contract_queries, ticket_queries, vector_queries, web_queries

MODULES = [contract_queries, ticket_queries, vector_queries, web_queries]
FLAGSHIP = "ticket_clean_pipeline"


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
