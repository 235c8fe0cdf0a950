"""Operators for text corpora: tokens, mixtures, shared spans and variant names."""
