"""Finite structural causal models as relational tables, analysed by Spark."""

__version__ = "0.1.0"
