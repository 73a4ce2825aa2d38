"""Operators for preparing large text corpora: scans, deduplication, tokenisation, packing and vector search.

Nothing outside this subpackage imports it.
"""
