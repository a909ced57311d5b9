"""Operators for large text corpora: tokenising, filtering, mixing, search and near-duplicate detection.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
