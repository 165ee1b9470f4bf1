"""Registered queries, by family."""

from . import evaluation_queries, ingest_queries, ledger_queries, linking_queries, name_queries, policy_queries, publish_queries, reference_queries, relation_queries, retrieval_queries, stream_queries, validation_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
