"""Operators for preparing large text corpora: quality, dedup, tokens, shards.

Nothing outside this subpackage imports it; deleting the folder leaves the rest
of the library whole.
"""
