"""Imports every module that registers queries."""

from tessella.plans import field_queries, measure_queries, object_queries, structure_queries, trace_queries

__all__ = ["field_queries", "measure_queries", "object_queries", "structure_queries", "trace_queries"]
