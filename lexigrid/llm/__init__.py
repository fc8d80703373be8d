"""Operators for building training corpora: deduplication, filtering, mixing, packing and scoring.

Nothing outside this subpackage imports it.  ``queries`` registers the operators' queries and their SQL.
"""
