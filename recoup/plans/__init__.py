"""Registered queries, each with its independent SQL twin where one exists."""
from recoup.plans.registry import ORACLES, QUERIES, oracle_sql, queries

__all__ = ["ORACLES", "QUERIES", "oracle_sql", "queries"]
