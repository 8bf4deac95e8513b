"""Spark-first engine for object-feature tables, spatial graphs, tracks and trace forests."""

__version__ = "0.1.0"
