"""Importing this package registers every query."""

from herdspark.plans import dirty_queries, formula_queries, gate_queries, model_queries, profile_queries, record_queries, rule_queries, split_queries, summary_queries  # noqa: F401
