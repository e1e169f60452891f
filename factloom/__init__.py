"""Fact-trie analytics on Spark: facts, prefix trees, look-up, decoding, evaluation reports."""

__version__ = "0.1.0"
