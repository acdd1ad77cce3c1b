"""Queries by operator; importing the package registers all of them."""

from . import inspection_queries, registry, rule_queries, second_stage_queries, sidecar_queries, stage_queries, token_queries, work_queries

__all__ = ["inspection_queries", "registry", "rule_queries", "second_stage_queries", "sidecar_queries", "stage_queries", "token_queries", "work_queries"]
