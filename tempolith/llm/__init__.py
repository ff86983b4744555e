"""Operators that prepare training data: dedup, language, quality, licences, tokens, shards, packing.

Nothing else in the library imports this subpackage; its queries are in ``queries``.
"""
